"""CSV tables with a header, quoted line breaks and empty cells for absent values."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; an empty cell is the empty string."""
    return spark.read.csv(
        path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, nullValue="\u0000", emptyValue=""
    ).na.fill("")


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn text columns into doubles, null where the text is no number."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def number_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn text columns into structs of ``whole``, ``number`` and ``text``, one of them set.

    A cell that reads as a whole number is a long (``3.0`` too), any other number a double,
    the rest stays text.  Whole numbers beyond a long stay doubles.
    """

    def cell(name: str) -> Column:
        value = F.when(~F.regexp_like(name, F.lit(r"[0-9.][dDfF]\s*$")), F.col(name)).try_cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 2.0**63)
        return F.struct(
            F.when(whole, value.cast("long")).alias("whole"),
            F.when(~whole, value).alias("number"),
            F.when(value.isNull(), F.col(name)).alias("text"),
        )

    return df.withColumns({c: cell(c) for c in columns})


def union_ragged(*tables: DataFrame) -> DataFrame:
    """Union by name; columns in first-seen order, absent cells null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(path: str, *tables: DataFrame) -> None:
    union_ragged(*tables).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue=""
    )
