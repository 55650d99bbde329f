"""Mixing sources to target weights by the cube method.

Every document of a source starts with the same inclusion probability.  Within a block the
flight phase takes three undecided documents at a time and moves their probabilities along
the null-space of the balancing constraints (words, documents) until one of them is 0 or 1.
A block leaves at most two undecided documents; these meet those of other blocks in the
next level, until each source has at most two left, whose landing is tried out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwright.llm.shared import keyed, landed, same

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
BLOCK_ROWS = 512
FAN_IN = 256  # blocks whose leftovers meet in one block of the next level
SPACES = r"[\x20\x09-\x0D]+"
LANDING = 10  # smallest documents that take part in the landing
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(``source``, ``source_size``, ``target``) from (``source``, ``source_size``); one row per source.

    Weights repeat along the sources in code-point order, null last.  The excess over the
    limit flows back by weight: the targets are ``min(limit * size, level * weight)`` for
    the one level at which they add up to the share of all sizes.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(limit))
    everything = Window.partitionBy(F.lit(1))
    # sources reach their cap in the order of cap / weight
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * float(share)
    level = ((total - capped) / open_weight).alias("level")
    levels = weighed.select("source", "source_size", "weight", "cap", level)
    # the first source whose cap is not reached at its own level sets the level
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight") * (1 + 1e-12), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return levels.select("source", "source_size", F.when(first.isNull(), F.col("cap")).otherwise(F.least("cap", first * F.col("weight"))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, count: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide all but at most two of the given documents, in their order; probabilities keep both balances."""
    p, open_ = p.astype(float).copy(), []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = round(p[k])
            continue
        open_.append(k)
        while len(open_) == 3:
            a, b, c = open_
            # the vector orthogonal to both constraint rows
            u = np.array([size[b] * count[c] - size[c] * count[b], size[c] * count[a] - size[a] * count[c], size[a] * count[b] - size[b] * count[a]], float)
            if not u.any():  # constraints in proportion: any vector orthogonal to one of them
                u = np.array([count[b], -count[a], 0.0])
            u /= np.abs(u).max()
            now = p[open_]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - now) / u, np.where(u < 0, -now / u, np.inf)).min()
                down = np.where(u > 0, now / u, np.where(u < 0, (now - 1) / u, np.inf)).min()
            now = now + u * (up if rng.random() * (up + down) < down else -down)
            for i, k_ in enumerate((a, b, c)):
                p[k_] = round(now[i]) if not EPS < now[i] < 1 - EPS else now[i]
            open_ = [i for i in open_ if EPS < p[i] < 1 - EPS]
    return p


def landing(before: np.ndarray, p: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Settle the last undecided documents together with the smallest ones of the block.

    All ways to round them are tried; that one wins whose words come nearest to what the
    probabilities ``before`` the flight promised, documents being a small part of the measure.
    """
    chance = (before > EPS) & (before < 1 - EPS)
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(left):
        return p.round()
    small = [i for i in np.argsort(size, kind="stable") if chance[i] and i not in left][:LANDING]
    free = np.concatenate([left, np.array(small, int)])
    ways = (np.arange(1 << len(free))[:, None] >> np.arange(len(free)) & 1).astype(float)
    fixed = np.setdiff1d(np.arange(len(p)), free)
    lacking = lambda x: (before * x).sum() - (p[fixed].round() * x[fixed]).sum()
    off = np.abs(ways @ size[free] - lacking(size)) + 0.01 * size.mean() * np.abs(ways @ count[free] - lacking(count))
    out = p.round()
    out[free] = ways[int(off.argmin())]
    return out


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = 11) -> DataFrame:
    """``doc_id``, ``source``, ``digest``, ``rows``, ``size``, ``source_size``, ``target``, ``copies`` of each distinct document.

    ``copies`` (0 to ``limit``) is how often the mix takes the document: the whole part of
    target / source size for sure, the rest by the cube method.  Repeated rows (equal id,
    source and text) stand or fall together; a null text has size 0; null ids and sources
    are values like any other; an empty table gives no rows.  Blocks follow from hashes, so
    reruns agree whatever the layout of the table.
    """
    read = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), word_count(F.col("text")).alias("size"))
    units = landed(read.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    aimed = landed(targets(by_source, weights, share, limit).join(by_source.select(F.col("source").alias("s"), "n_units"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    most = aimed.agg(F.max("n_units")).first()[0] or 0
    few = aimed.limit(100_001).count() <= 100_000  # one row per source: small, but measured
    aimed = aimed.withColumnRenamed("source", "s")
    joined = units.join(F.broadcast(aimed) if few else aimed, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.xxhash64("doc_id", "digest", F.lit(seed))
    started = joined.withColumn("rate", rate).select(
        "doc_id", "source", "digest", "size", "rows", "source_size", "target", F.floor("rate").alias("sure"), (F.col("rate") - F.floor("rate")).alias("p"),
        F.pmod(place, F.ceil(F.col("n_units") / BLOCK_ROWS)).alias("block"), place.alias("place"),
    )
    done, level, blocks = None, 0, -(-most // BLOCK_ROWS)
    while True:
        last = blocks <= 1
        step = landed(_level(started, last, seed + level), f"mix-level-{level}")
        decided = step if last else step.where(f"p < {EPS} OR p > {1 - EPS}")
        done = decided if done is None else done.union(decided)
        if last:
            break
        started = step.where(f"p BETWEEN {EPS} AND {1 - EPS}").withColumn("block", F.floor(F.col("block") / FAN_IN))
        level, blocks = level + 1, -(-blocks // FAN_IN)
    return done.select("doc_id", "source", "digest", "rows", "size", "source_size", "target", (F.col("sure") + F.round("p")).cast("int").alias("copies"))


def _level(units: DataFrame, last: bool, seed: int) -> DataFrame:
    """Run the flight in every (source, block); on the last level land what is left."""

    def run(block: pa.Table) -> pa.Table:
        number = {c: block[c].to_numpy() for c in ("size", "rows", "place", "digest", "p")}
        order = np.lexsort((number["digest"], number["place"], -number["size"]))  # small documents stay open longest
        size, count, p = ((number[c][order]).astype(float) for c in ("size", "rows", "p"))
        size *= count
        promised, p = p, flight(p, size, count, np.random.default_rng([seed, int(number["place"].min()) & 0xFFFFFFFF]))
        block = block.take(pa.array(order))
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(landing(promised, p, size, count) if last else p))

    return units.groupBy("source", "block").applyInArrow(run, units.schema)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: a row taken twice comes twice, a row not taken is gone; the columns stay."""
    plan = mix_plan(docs, **options).where("copies > 0").select(F.col("doc_id").alias("id_"), F.col("source").alias("source_"), F.col("digest").alias("digest_"), "copies")
    rows = keyed(docs).withColumn("source", F.col("row.source"))
    met = rows.join(plan, same(rows, plan, {"doc_id": "id_", "digest": "digest_", "source": "source_"}))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
