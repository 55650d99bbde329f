"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c or more are within squared distance 2 - 2c.  After a random
rotation the coordinates are split into blocks, each with its proportional share of that
budget: two such vectors are within the share in at least one block.  So every block is
range-joined by itself: slabs along its first coordinate, as wide as the block's radius,
meet themselves and the next slab; pairs within the block's budget are verified on all
coordinates.  A pair is counted only in the block where it is relatively nearest, so the
union of the blocks' candidates needs no removal of repeats.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairwright.llm.components import components, stars
from pairwright.llm.shared import landed

COSINE = 0.9
BLOCK_DIMS = 16
TILE_ROWS = 1024
GUARD = 1e-6  # of the single-precision block filter; more than its error
SEED = 3


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, block_dims: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    n = max(1, round(dims / block_dims))
    cuts = [round(i * dims / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _placed(cosine: float, block_dims: int):
    budget = 2 - 2 * cosine

    def place(batches):
        turned_by: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch["vector"]
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                v = flat[starts[rows][:, None] + np.arange(dims)]
                v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                turn = turned_by.setdefault(int(dims), rotation(int(dims)))
                turned = v @ turn
                raw = [row.tobytes() for row in turned.astype("<f8")]
                own = batch.select(["class", "n"]).take(pa.array(rows))
                for b, (lo, hi) in enumerate(blocks_of(int(dims), block_dims)):
                    radius = max(np.sqrt(budget * (hi - lo) / dims), 1e-3) + GUARD
                    slab = np.floor(turned[:, lo] / radius).astype(np.int32)
                    fixed = [pa.array(np.full(len(rows), x, np.int32)) for x in (dims, b)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *fixed, pa.array(slab), pa.array(raw, pa.binary())], names=["class", "n", "dims", "part", "slab", "turned"])

    return place


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles from a column of their bytes, without an object for each row."""
    vectors = vectors.cast(pa.large_binary())
    at = np.frombuffer(vectors.buffers()[1], np.int64)[vectors.offset : vectors.offset + len(vectors) + 1]
    return np.frombuffer(vectors.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view("<f8").reshape(-1, dims)


def _verified(cosine: float, block_dims: int):
    budget = 2 - 2 * cosine

    def compare(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                dims, part, same_tile = (batch[c][row].as_py() for c in ("dims", "part", "same_tile"))
                x, y = (_matrix(batch[c][row].values, dims) for c in ("own", "other"))
                cx, cy, nx, ny = (batch[c][row].values.to_numpy() for c in ("own_class", "other_class", "own_n", "other_n"))
                cuts = blocks_of(dims, block_dims)
                lo, hi = cuts[part]
                bx, by = x[:, lo:hi].astype(np.float32), y[:, lo:hi].astype(np.float32)
                one = lambda m: np.ones((len(m), 1), np.float32)
                # squared distances as one product: (p, |p|^2, 1) times (-2q, 1, |q|^2)
                left = np.hstack([bx, (bx * bx).sum(axis=1, keepdims=True), one(bx)])
                right = np.ascontiguousarray(np.hstack([-2 * by, one(by), (by * by).sum(axis=1, keepdims=True)]).T)
                limit = np.float32(budget * (hi - lo) / dims + GUARD * 10)
                from_, to = [], []
                for start in range(0, len(x), 256):
                    near = np.flatnonzero(left[start : start + 256] @ right <= limit)
                    i, j = np.divmod(near, len(y))
                    i += start
                    differ = cx[i] < cy[j] if same_tile else cx[i] != cy[j]
                    i, j = i[differ], j[differ]
                    for cut in range(0, len(i), 1 << 16):
                        a, b = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                        gap = (x[a] - y[b]) ** 2
                        share = np.stack([gap[:, s:e].sum(axis=1) / (e - s) for s, e in cuts], axis=1)
                        good = (share.argmin(axis=1) == part) & (np.einsum("ij,ij->i", x[a], y[b]) >= cosine)
                        from_.append(a[good])
                        to.append(b[good])
                a, b = np.concatenate([*from_, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*to, np.zeros(0, np.int64)]).astype(np.int64)
                if not len(a):
                    continue
                # per class the linked vectors of this tile pair, and its star
                ids, at = np.unique(np.concatenate([cx[a], cy[b]]), return_inverse=True)
                links = np.bincount(at, weights=np.concatenate([ny[b], nx[a]]).astype(float), minlength=len(ids)).astype(np.int64)
                node, root = stars(cx[a], cy[b])
                roots = ids.copy()
                roots[np.searchsorted(ids, node)] = root
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots), pa.array(links)], names=["node", "root", "links"])

    return compare


def class_links(distinct: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(``node``, ``root``, ``links``) from (``class``, ``n``, ``vector``): star links and partial counts of linked vectors."""
    kind = "class long, n long, dims int, part int, slab int, turned binary"
    placed = landed(distinct.mapInArrow(_placed(cosine, block_dims), kind), "vector-blocks")
    slab = ["dims", "part", "slab"]
    sizes = placed.groupBy(*slab).agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("tiles"))
    # slabs are bounded: unit vectors, fixed width
    tiles = placed.join(F.broadcast(sizes), slab).groupBy(*slab, F.pmod(F.xxhash64("class"), F.col("tiles")).alias("tile")).agg(F.collect_list(F.struct("class", "n", "turned")).alias("rows"))
    tiles = landed(tiles, "vector-tiles")
    own = tiles.select(*slab, "tile", F.col("rows.class").alias("own_class"), F.col("rows.n").alias("own_n"), F.col("rows.turned").alias("own"))
    other = tiles.select(
        "dims", "part", F.explode(F.array(F.lit(0), F.lit(1))).alias("move"), (F.col("slab") + F.col("move")).alias("slab"), F.col("tile").alias("other_tile"),
        F.col("rows.class").alias("other_class"), F.col("rows.n").alias("other_n"), F.col("rows.turned").alias("other"),
    )
    met = own.join(other, slab).where("move = 1 OR tile <= other_tile")
    met = met.withColumn("same_tile", F.expr("move = 0 AND tile = other_tile")).drop("slab", "tile", "other_tile", "move")
    return met.mapInArrow(_verified(cosine, block_dims), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, tile_rows: int = TILE_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` per vector row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing and are kept; so do vectors of different lengths.  Equal vectors are one class
    and link with each other; repeated rows count as vectors of their own.  A null id never
    is a component's smallest id; a component without any id has a null one, and its rows
    are not kept.
    """
    v = F.col(embedding)
    sound = F.coalesce(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    read = vectors.select(F.col(vec_id).alias("vec_id"), F.when(sound, v).alias("v"))
    # both hashes together name the class of equal vectors
    marks = {"h1": F.xxhash64("v"), "h2": F.hash("v")}
    ids = landed(read.select("vec_id", F.col("v").isNotNull().alias("sound"), *(m.alias(k) for k, m in marks.items())), "vector-ids")
    grouped = read.where("v IS NOT NULL").groupBy(*(m.alias(k) for k, m in marks.items())).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("vector"))
    distinct = landed(grouped.withColumn("class", F.xxhash64("h1", "h2")), "vector-classes")
    found = landed(class_links(distinct.select("class", "n", "vector"), cosine, block_dims, tile_rows), "vector-links")
    linked = components(found.select("node", "root"), "vector-components").withColumnRenamed("node", "class")
    counts = found.groupBy(F.col("node").alias("class")).agg(F.sum("links").alias("links"))
    rooted = distinct.select("class", "h1", "h2", "first", "n").join(linked, "class", "left").join(counts, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component", F.lit(True).alias("sound"))
    alone = ids.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = ids.where("sound").join(named, ["h1", "h2"]).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
    return met.unionByName(alone)
