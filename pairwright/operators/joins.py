"""Joins that stay balanced when one key holds a large share of the rows, and winner rows per key.

AQE splits a skewed partition only when both join inputs come straight from a shuffle.
Here the right side is usually an aggregate (one row per key), so the split can be made
explicit: left rows of the keys named as heavy get a salt, and just those keys' right rows
are replicated once per salt.  Both sides are read and shuffled once, and any choice of
heavy keys gives the same result, copies of one row included.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwright.operators.quantiles import same_keys

MAX_HEAVY_KEYS = 100
TRACKED_KEYS = 10_000
MIN_HEAVY_ROWS = 200_000
SALTS = 64
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
NUMBERED_BLOCK = 4096


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, on: list[str], min_rows: int = MIN_HEAVY_ROWS) -> list[int]:
    """Hashes of the keys that hold more than one partition's fair share of the rows.

    One pass over the key columns with a fixed-size sketch; at most ``MAX_HEAVY_KEYS``
    hash values come back to the driver.
    """
    found = (
        df.select(F.xxhash64(*on).alias("h"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"approx_top_k(h, {MAX_HEAVY_KEYS}, {TRACKED_KEYS})").alias("top"),
        )
        .first()
    )
    share = max(min_rows, found.n / shuffle_partitions(df))
    return [item["item"] for item in (found.top or []) if item["count"] >= share]


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", heavy: list[int] | None = None, salts: int = SALTS) -> DataFrame:
    """Join a fact table with a table that has one row per key; ``left`` keys may be skewed.

    ``how`` is inner, left, left_semi or left_anti.  ``heavy`` are hashes of keys as
    ``heavy_keys`` finds them, an action of its own that the caller asks for; without them
    this is a plain join.
    """
    if not heavy:
        return left.join(right, on, how)
    hot = F.xxhash64(*on).isin(heavy)
    # the salt follows from the row, so a task that runs again deals its rows alike
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns if not dict(left.dtypes)[c].startswith("map")), F.lit("salt")), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", F.when(hot, spread).otherwise(0))
    copies = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def _width(df: DataFrame) -> Column:
    """Approximate bytes of a row."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return width


def dimension_join(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Broadcast the dimension when its measured size is small, else join by key."""
    size = dimension.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_width(dimension)), F.lit(0)).alias("bytes")
    ).first()
    if size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:
        return facts.join(F.broadcast(dimension), on, how)
    return keyed_join(facts, dimension, on, how)


def _ordinal(order: Column, row: Column, largest: bool) -> Column:
    """One number for the order and, among equal orders, a hash of the row: hash aggregates hold it in place."""
    tie = F.shiftrightunsigned(F.xxhash64(row), 4).cast("decimal(19,0)")  # 60 bits
    sign = F.lit(1 if largest else -1)
    place = (order.cast("decimal(19,0)") * sign).cast("decimal(38,0)") * F.lit(1 << 60).cast("decimal(19,0)")
    return F.coalesce(place, F.lit(f"-9{'0' * 37}").cast("decimal(38,0)")) + tie


def winners(df: DataFrame, key: list[str], order: str, largest: bool = True) -> DataFrame:
    """The row of each key with the largest (or smallest) ``order``, a whole number; a null order loses to any other.

    Of several rows with that order the one with the largest hash wins, so reruns agree.
    Only keys and ordinals are aggregated; the rows themselves are fetched by a semi-join
    (which a runtime Bloom filter may thin out in the scan), and of repeated rows one stays.
    Null keys are keys.
    """
    clear = [F.col(f"`{c}`") if not kind.startswith("map") else F.to_json(F.col(f"`{c}`")) for c, kind in df.dtypes]
    ranked = df.withColumn("_rank", _ordinal(F.col(order), F.struct(*clear), largest))
    best = ranked.groupBy(*key).agg(F.max("_rank").alias("_best")).withColumnsRenamed({k: f"{k}_of" for k in key})
    same = F.col("_rank") == F.col("_best")
    for k in key:
        same &= ranked[k].eqNullSafe(best[f"{k}_of"])
    met = ranked.join(best, same, "left_semi").drop("_rank")
    once = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    return met.withColumn("_nth", once).where("_nth = 1").select(*df.columns)


def numbered(df: DataFrame, key: list[str], order: str, block: int = NUMBERED_BLOCK) -> DataFrame:
    """``df`` with ``nth``, the place of a row from 1 among the rows of its key in the order of ``order``, a whole number.

    Rows are placed in blocks of ``block`` consecutive orders, a task each, behind the counts
    of the blocks before: no task holds a whole key.  Null keys are keys; rows of one order
    come in any sequence.
    """
    dealt = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = dealt.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*key, "_block").orderBy(order)).cast("long")
    return same_keys(dealt.withColumn("_place", place), before, [*key, "_block"]).withColumn("nth", F.col("_before") + F.col("_place")).drop("_block", "_before", "_place")


def last_by_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` per key."""
    return winners(df, key, order)


def first_by_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the lowest ``order`` per key."""
    return winners(df, key, order, largest=False)


def pending(requests: DataFrame, done: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Requests without an answer yet (resume)."""
    return keyed_join(requests, done.select(key).distinct(), [key], "left_anti")
