"""SimHash near-dedup by tiled exact comparison.

Equal fingerprints are one class.  The distinct fingerprints are laid out in tiles by the
population counts of their four 16-bit quarters; two tiles meet only if those counts differ
by no more than the radius in sum (a lower bound of the Hamming distance), and are then
compared in full with exclusive-or and bit counts.  Each task turns its links into stars
before they leave it, so a group of near copies never becomes a list of pairs.
"""

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pairwright.llm.components import components, stars
from pairwright.llm.shared import keyed, landed, occurrence, same

SHINGLE_WORDS, RADIUS = 3, 3
SEED = 42
TILE_ROWS = 2048
FLUSH_LINKS = 1 << 20
QUARTERS, COUNTS = 4, 17  # counts of a quarter: 0 to 16


def shingle_hashes(data: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; a text shorter than a shingle is one, one without words has none."""
    found = (data or b"").lower().split()  # the six ASCII spaces
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], "<u8")


def fingerprint(data: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of all word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(data, words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t, words) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
        return pa.array(found.view(np.int64))

    return simhash(text)


def _quarter(i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int")


def _half_ball(radius: int) -> list[tuple[int, ...]]:
    """Count differences within the radius, one of each opposite pair, zero first."""
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]


def _compare(radius: int):
    def links(batches):
        a, b, held = [], [], 0
        for batch in batches:
            left, right = batch["own"], batch["other"]
            for i in range(batch.num_rows):
                x = left[i].values.to_numpy().view(np.uint64)
                y = right[i].values.to_numpy().view(np.uint64)
                for start in range(0, len(x), 256):
                    part = x[start : start + 256]
                    at, to = np.nonzero(np.bitwise_count(part[:, None] ^ y[None, :]) <= radius)
                    differ = part[at] != y[to]
                    a.append(part[at][differ].view(np.int64))
                    b.append(y[to][differ].view(np.int64))
                    held += len(a[-1])
                if held >= FLUSH_LINKS:  # keep what a task holds bounded
                    star = stars(np.concatenate(a), np.concatenate(b))
                    a, b, held = [star[0]], [star[1]], 0
                    if len(star[0]) >= FLUSH_LINKS // 2:
                        yield _edges(*star)
                        a, b = [], []
        if a:
            yield _edges(*stars(np.concatenate(a), np.concatenate(b)))

    return links


def _edges(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def near_links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (``node``, ``root``) that span every group of distinct ``fp`` within the radius of each other."""
    cells = distinct.select("fp", F.array(*(_quarter(i) for i in range(QUARTERS))).alias("counts"))
    sizes = cells.groupBy("counts").agg(F.count(F.lit(1)).alias("n"))  # at most 17^4 = 83,521 rows
    blocks = F.ceil(F.col("n") / tile_rows)
    tiles = cells.join(F.broadcast(sizes), "counts").groupBy("counts", F.pmod(F.xxhash64("fp"), blocks).alias("block")).agg(F.collect_list("fp").alias("fps"))
    tiles = landed(tiles, "simhash-tiles")
    moves = F.array(*(F.array(*map(F.lit, d)) for d in _half_ball(radius)))
    target = F.zip_with("counts", "move", lambda c, d: c + d)
    visits = (
        tiles.select("counts", F.col("block").alias("from_block"), F.col("fps").alias("other"), F.explode(moves).alias("move"))
        .select("from_block", "other", F.forall("move", lambda d: d == 0).alias("home"), target.alias("counts"))
        .join(F.broadcast(sizes.select("counts")), "counts", "left_semi")
    )
    met = tiles.withColumnRenamed("fps", "own").join(visits, "counts").where("NOT home OR from_block <= block")
    return met.select("own", "other").mapInArrow(_compare(radius), "node long, root long")


def classes(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents, fingerprints): ``doc_id``, ``digest``, ``fp`` per row; ``fp``, ``first``, ``root`` per fingerprint.

    ``first`` is the smallest (``no_id``, ``doc_id``, ``digest``) of the whole group, null ids last.
    """
    prints = landed(docs.select("doc_id", F.xxhash64("text").alias("digest"), fingerprints(F.col("text"), words).alias("fp")), "simhash-prints")
    distinct = landed(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")), "simhash-classes")
    linked = components(near_links(distinct, radius, tile_rows), "simhash-links").withColumnRenamed("node", "fp")
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return prints, rooted.select("fp", "root").join(groups, "root")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``digest``, ``fingerprint`` (16 hex digits), ``component_id`` per document row.

    ``component_id`` is the smallest id reachable over fingerprints within the radius, null
    only if no document there has an id.  Null, empty and wordless texts have fingerprint 0
    and link like any other; repeated rows are reported one by one; an empty table gives no
    rows.
    """
    prints, groups = classes(docs, **options)
    return prints.join(groups, "fp").select("doc_id", "digest", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, that with the smallest id (null last); all columns stay, repeated rows go."""
    _, groups = classes(docs, **options)
    return keep_rows(docs, groups)


def keep_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows that ``first`` of ``groups`` names, each once, with all columns."""
    stay = groups.select(F.col("first.doc_id").alias("id_"), F.col("first.digest").alias("digest_")).distinct()
    rows = keyed(docs)
    met = rows.join(stay, same(rows, stay, {"doc_id": "id_", "digest": "digest_"}), "left_semi")
    return met.withColumn("nth", occurrence(["doc_id", "digest"])).where("nth = 1").select("row.*")
