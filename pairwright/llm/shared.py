"""Helpers shared by the corpus operators."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwright.session import fresh_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder of ``spark.checkpoint.dir`` and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.landed_at = path
    return back


def released(table: DataFrame) -> None:
    """Empty a landed table that nothing will read any more, so that its disk is free before the operator ends."""
    table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(table.landed_at)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other scripts stay as they are."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def same(left: DataFrame, right: DataFrame, on: dict[str, str]) -> Column:
    """Null-safe equality of several columns."""
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in on.items()))


def keyed(docs: DataFrame) -> DataFrame:
    """(``row``: all columns as one struct, ``doc_id``, ``digest``): names of the table cannot clash with ours.

    ``digest`` is a hash of the text; rows with equal id and text are repeated rows.
    """
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("digest"))


def occurrence(key: list[str]) -> Column:
    """1, 2, … within the repeated rows of a key."""
    return F.row_number().over(Window.partitionBy(*key).orderBy(key[-1]))


def replaced(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Without the columns an operator is about to add: the operator's columns win."""
    taken = {c.lower() for c in columns}
    return docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in taken))
