"""Deterministic train/val/test split by id.

Ids are ordered by ``md5(seed:id)`` and cut by exact counts.  No id list is sorted or
joined back: the two cut positions are found from a histogram over hash prefixes (a
fixed number of rows) plus the ranks inside the two prefixes that hold a cut, and every
row then compares its own hash with the two cut points.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

PREFIX_HEX_DIGITS = 4


def _order(key: str, seed: int) -> Column:
    return F.struct(
        F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("h"),
        F.col(key).cast("string").alias("id"),
    )


def split_counts(total: Column, train_ratio: float, val_ratio: float) -> tuple[Column, Column]:
    """Number of ids in train and val; from three ids on every split gets at least one."""
    train = F.floor(total * F.lit(float(train_ratio)))
    val = F.floor(total * F.lit(float(val_ratio)))
    train_clamped = F.greatest(F.lit(1), F.least(train, total - 2))
    val_clamped = F.greatest(F.lit(1), F.least(val, total - train_clamped - 1))
    return (
        F.when(total >= 3, train_clamped).otherwise(train),
        F.when(total >= 3, val_clamped).otherwise(val),
    )


def cut_points(ids: DataFrame, train_ratio: float, val_ratio: float) -> DataFrame:
    """One row: the last position of train (``train``) and of train plus val (``val``)."""
    prefixed = ids.withColumn("prefix", F.substring(F.col("o.h"), 1, PREFIX_HEX_DIGITS))
    histogram = prefixed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = histogram.select(
        "prefix",
        "n",
        F.sum("n").over(running).alias("upto"),
        F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    train, val = split_counts(F.col("total"), train_ratio, val_ratio)
    cuts = cumulated.select(
        "prefix",
        (F.col("upto") - F.col("n")).alias("before"),
        "upto",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("cut"), train.alias("at")),
                F.struct(F.lit("val").alias("cut"), (train + val).alias("at")),
            )
        ).alias("c"),
    ).where((F.col("c.at") > F.col("before")) & (F.col("c.at") <= F.col("upto")))
    # at most two rows: the prefixes that hold a cut
    near = prefixed.join(F.broadcast(cuts), "prefix")
    rank = F.row_number().over(Window.partitionBy("c.cut").orderBy("o"))
    return (
        near.withColumn("rank", rank + F.col("before"))
        .where(F.col("rank") == F.col("c.at"))
        .agg(
            F.max(F.when(F.col("c.cut") == "train", F.col("o"))).alias("train"),
            F.max(F.when(F.col("c.cut") == "val", F.col("o"))).alias("val"),
        )
    )


def split_by_id(
    df: DataFrame, key: str = "prompt_id", train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 13
) -> DataFrame:
    """Add a ``split`` column; all rows of an id share a split.

    The two cut points are found right away (two ids on the driver), so that reading the
    result several times does not look for them again.
    """
    if train_ratio < 0 or val_ratio < 0 or train_ratio + val_ratio > 1:
        raise ValueError("train_ratio and val_ratio must not be negative nor add up to more than 1")
    ids = df.select(F.col(key).cast("string").alias(key)).distinct().select(_order(key, seed).alias("o"))
    cuts = cut_points(ids, train_ratio, val_ratio).first()
    here = _order(key, seed)

    def upto(cut) -> Column:
        if cut is None:
            return F.lit(False)
        return here <= F.struct(F.lit(cut.h).alias("h"), F.lit(cut.id).alias("id"))

    return df.withColumn("split", F.when(upto(cuts.train), "train").when(upto(cuts.val), "val").otherwise("test"))


def shared_ids(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Ids found in more than one split; empty for a sound split."""
    ends = df.groupBy(key).agg(F.min("split").alias("first"), F.max("split").alias("last"))
    return ends.where(F.col("first") != F.col("last")).select(key)
