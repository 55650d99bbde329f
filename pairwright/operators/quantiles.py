"""Group statistics with an exact median of unbounded groups.

``percentile`` keeps every distinct value of a group in one buffer, and a rank window sorts a
group in one task.  Here the median is selected by nested histograms: the bits of a double
are mapped to a whole number of the same order, a pass counts the values of each group by
the number's highest 16 bits, the bucket that holds the middle rank is opened by the next
16 bits, and after four passes it holds one value.  Counting combines map-side, so a group
sends at most 65,536 counts a task and pass, however many values it has.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pairwright.session import landed

STEP = 16
LEVELS = (48, 32, 16, 0)
_FRACTION = 52


def order_key(value: Column) -> Column:
    """A whole number for a double, in the same order: its IEEE bits, counted down below zero; NaN is the largest."""
    size = F.abs(value)
    log = F.floor(F.log2(size)).cast("int")
    # a logarithm may round to the next whole number
    exponent = log + F.when(size >= F.pow(F.lit(2.0), log + 1), 1).when(size < F.pow(F.lit(2.0), log), -1).otherwise(0)
    unit = F.lit(2.0 ** -537)
    normal = (F.lit(1023) + exponent).cast("long") * (1 << _FRACTION) + ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << _FRACTION)).cast("long")
    bits = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size == float("inf"), F.lit(2047 << _FRACTION))
        .when(size < 2.0**-1022, (size / unit / unit).cast("long"))
        .otherwise(normal)
    )
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -bits).otherwise(bits)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's are dropped."""
    renamed = right.withColumnsRenamed({k: f"{k}_of" for k in keys})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"{k}_of"]) for k in keys))
    return left.join(renamed, on, how).drop(*(f"{k}_of" for k in keys))


def _opened(cells: Column, rank: Column) -> Column:
    """struct(left, bucket): the bucket that holds a rank, and the rank within it."""

    def step(state: Column, cell: Column) -> Column:
        open_ = state["bucket"].isNull()
        here = open_ & (state["left"] <= cell["n"])
        return F.struct(
            F.when(open_ & ~here, state["left"] - cell["n"]).otherwise(state["left"]).alias("left"),
            F.when(here, cell["bucket"]).otherwise(state["bucket"]).alias("bucket"),
        )

    return F.aggregate(cells, F.struct(rank.alias("left"), F.lit(None).cast("long").alias("bucket")), step)


def middle_keys(histogram: Callable[[DataFrame | None, int], DataFrame], keys: list[str]) -> DataFrame:
    """``keys`` and ``middle``, the order key of each group's lower median.

    ``histogram(opened, shift)`` counts the order keys, shifted right, of all values (opened
    is None) or of those in the opened buckets, as (keys, ``bucket``, ``n``); ``opened`` has
    keys and ``prefix``, an order key shifted by ``STEP`` bits more.
    """
    opened = None
    for shift in LEVELS:
        counts = histogram(None if opened is None else opened.select(*keys, "prefix"), shift)
        cells = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("total"))
        if opened is None:
            ranked = cells.withColumn("rank", F.floor((F.col("total") + 1) / 2))
        else:
            ranked = same_keys(cells, opened.select(*keys, "rank"), keys)
        opened = ranked.select(*keys, _opened(F.col("cells"), F.col("rank")).alias("o")).select(*keys, F.col("o.bucket").alias("prefix"), F.col("o.left").alias("rank"))
    return opened.select(*keys, F.col("prefix").alias("middle"))


def exact_median(values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys`` and the median of column ``value`` as ``name``, of every group with a value.  ``values`` is read five times."""
    numbers = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    numbers = numbers.withColumn("_k", order_key(F.col("_v")))

    def histogram(opened: DataFrame | None, shift: int) -> DataFrame:
        found = numbers if opened is None else same_keys(numbers, opened, keys).where(F.shiftright("_k", shift + STEP) == F.col("prefix"))
        return found.groupBy(*keys, F.shiftright("_k", shift).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    around = same_keys(numbers, middle_keys(histogram, keys), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_k") <= F.col("middle")).alias("upto"),
        F.max(F.when(F.col("_k") == F.col("middle"), F.col("_v"))).alias("low"), F.min(F.when(F.col("_k") > F.col("middle"), F.col("_v"))).alias("next"),
    )
    high = F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("low")).otherwise(F.col("next"))
    return around.select(*keys, ((F.col("low") + high) / 2).alias(name))


def stats_with_median(df: DataFrame, keys: list[str], aggregates: list[Column], value: str, name: str) -> DataFrame:
    """``aggregates`` per group plus the exact median of column ``value`` as ``name``; null for a group without values.

    ``df`` should hold the needed numbers only: it is written once to the shared folder and
    read from there.  Without ``keys`` there is one row, also of an empty table.
    """
    kept = landed(df if keys else df.withColumn("_all", F.lit(0)), "numbers")
    first, median = kept.groupBy(*keys).agg(*aggregates), exact_median(kept, keys or ["_all"], value, name)
    return same_keys(first, median, keys, "left") if keys else first.withColumn(name, median.select(name).scalar())
