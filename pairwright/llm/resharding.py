"""Resharding by minimum-cost flow.

Old shards with their bytes are the sources, new shards with their capacities the sinks; a
byte that stays costs nothing, a byte that moves costs one.  The flow says how many bytes go
from each old shard to each new one.  Within an old shard the documents lie in blocks, large
documents first, so what stays and what moves is cut between blocks, at small documents.
Equal texts lie side by side, and a cut goes around their group unless the group is large.
"""

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairwright.llm.shared import keyed, landed, occurrence, replaced, same

SHARDS = 40
OVERHEAD = 16
BLOCK_ROWS = 2048
GROUP_ROWS = 512  # equal texts beyond are dealt over several blocks
GROUP_SHARE = 50  # a group of equal texts up to this part of a shard is never cut
BROADCAST_GROUPS = 100_000
FILE_ROWS = 100_000
ADDED = ["size", "text_crc32", "shard", "slot", "old_shard"]


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of a flow that sends the whole supply at the least cost: shortest augmenting paths with potentials.

    ``cost(old, new)`` is the cost of a byte; supplies and capacities are whole numbers with
    equal sums.  Only shard totals come here.
    """
    m, k = len(supply), len(capacity)
    flow = [[0] * k for _ in range(m)]
    left, room = list(supply), list(capacity)
    high_m, high_k = [0.0] * m, [0.0] * k  # potentials
    while any(left):
        dist = {("m", i): 0.0 for i in range(m) if left[i]}
        back: dict = {}
        heap = [(0.0, "m", i) for i in range(m) if left[i]]
        done = set()
        while heap:
            d, side, i = heapq.heappop(heap)
            if (side, i) in done:
                continue
            done.add((side, i))
            if side == "m":
                steps = (("k", j, cost(i, j) + high_m[i] - high_k[j]) for j in range(k))
            else:
                steps = (("m", h, -cost(h, i) + high_k[i] - high_m[h]) for h in range(m) if flow[h][i])
            for to, j, c in steps:
                if d + c < dist.get((to, j), float("inf")) - 1e-12:
                    dist[(to, j)] = d + c
                    back[(to, j)] = i
                    heapq.heappush(heap, (d + c, to, j))
        ends = [(dist[("k", j)] + high_k[j], j) for j in range(k) if room[j] and ("k", j) in dist]
        _, end = min(ends)
        path, at = [], ("k", end)
        while at in back:
            came = ("m" if at[0] == "k" else "k", back[at])
            path.append((came, at))
            at = came
        amount = min([room[end], left[at[1]], *(flow[to[1]][came[1]] for came, to in path if came[0] == "k")])
        for came, to in path:
            if came[0] == "m":
                flow[came[1]][to[1]] += amount
            else:
                flow[to[1]][came[1]] -= amount
        left[at[1]] -= amount
        room[end] -= amount
        for (side, i), d in dist.items():
            if side == "m":
                high_m[i] += d
            else:
                high_k[i] += d
    return [(i, j, flow[i][j]) for i in range(m) for j in range(k) if flow[i][j]]


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares, the remainder a byte each on the first shards."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan(docs: DataFrame, shards: int = SHARDS, old_shard=None, capacity: list[int] | None = None, moved_cost=None) -> DataFrame:
    """One row per distinct document: ``doc_id``, ``digest``, ``rows``, ``size``, ``text_crc32``, ``old_shard``, ``shard``, ``slot``.

    ``old_shard`` is a column (0 up; by default a hash of the text, which puts equal texts
    together), ``capacity`` the bytes each new shard is to hold (by default equal), and must
    add up to all bytes.  Repeated rows share one entry and take ``rows`` slots from
    ``slot`` on.  Equal texts of one old shard stay together up to ``GROUP_ROWS`` documents and
    a part of ``GROUP_SHARE`` of a shard; so many bytes a shard may miss its capacity by at
    either end of a stretch.  A null text has 0 bytes and a null checksum; an empty table gives
    no rows.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long")
    home = F.pmod(F.xxhash64("text"), F.lit(shards)) if old_shard is None else old_shard
    read = docs.select("doc_id", F.xxhash64("text").alias("digest"), size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), home.cast("int").alias("old_shard"))
    units = landed(read.groupBy("doc_id", "digest", "size", "text_crc32", "old_shard").agg(F.count(F.lit(1)).alias("rows")), "shard-units")

    # blocks: size classes of an old shard, large first, dealt out by hash to a bounded number of rows
    kind = (16 * 48 - F.floor(F.log2("size") * 16)).cast("int").alias("kind")
    of_kind = units.groupBy("old_shard", kind).agg(F.count(F.lit(1)).alias("n"))
    parts = of_kind.select(F.col("old_shard").alias("o"), F.col("kind").alias("k"), F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"))
    # a row for each old shard and size class: 768 classes at most
    units = units.withColumn("kind", kind).join(F.broadcast(parts), (F.col("old_shard") == F.col("o")) & (F.col("kind") == F.col("k"))).drop("o", "k")
    crowds = units.groupBy(F.col("digest").alias("crowd")).agg(F.count(F.lit(1)).alias("n")).where(f"n > {GROUP_ROWS}").select("crowd")
    crowds = landed(crowds, "shard-crowds")
    few = crowds.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    units = units.join(F.broadcast(crowds) if few else crowds, F.col("digest") == F.col("crowd"), "left")
    dealt = F.when(F.col("crowd").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("digest", "doc_id"))
    units = units.withColumn("block", F.pmod(dealt, F.col("parts"))).drop("parts")
    blocks = units.groupBy("old_shard", "kind", "block").agg(F.sum(F.col("size") * F.col("rows")).alias("bytes"))
    before = Window.partitionBy("old_shard").orderBy("kind", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = landed(blocks.withColumn("block_start", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "shard-blocks")

    held = {r.old_shard: r.bytes for r in blocks.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}  # one number a shard
    old = sorted(held)
    supply = [held[o] for o in old]
    room = capacity or capacities(sum(supply), shards)
    if sum(room) != sum(supply) or len(room) != shards:
        raise ValueError("the capacities must add up to all bytes, one for each new shard")
    flow = min_cost_flow(supply, room, moved_cost and (lambda i, j: moved_cost(old[i], j)) or (lambda i, j: float(old[i] != j)))
    # the stretch of an old shard's bytes that goes to each new shard: what stays comes first
    stretches = []
    for i, o in enumerate(old):
        at = 0
        for _, j, amount in sorted((f for f in flow if f[0] == i), key=lambda f: (f[1] != o, f[1])):
            at += amount
            stretches.append((o, at, j))
    spark = docs.sparkSession
    # at most (old + new) rows
    ends = spark.createDataFrame(stretches or [(-1, 0, 0)], "old_shard int, end long, shard int").groupBy("old_shard").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))

    block = Window.partitionBy("old_shard", "kind", "block")
    in_order = [F.desc("size"), F.col("digest"), F.col("doc_id").asc_nulls_last()]
    weight = F.col("size") * F.col("rows")
    own_end = F.sum(weight).over(block.orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0))
    group_end = F.sum(weight).over(block.orderBy(*in_order[:2]).rangeBetween(Window.unboundedPreceding, 0))
    group = F.sum(weight).over(Window.partitionBy("old_shard", "kind", "block", "size", "digest"))
    whole = F.col("crowd").isNull() & (F.col("group") <= max(1, min(room) // GROUP_SHARE))
    placed = units.join(blocks.drop("bytes"), ["old_shard", "kind", "block"]).withColumns({"own_end": own_end, "group_end": group_end, "group": group})
    placed = placed.withColumn("middle", F.col("block_start") + F.when(whole, F.col("group_end") - F.col("group") / 2).otherwise(F.col("own_end") - weight / 2))
    placed = placed.join(F.broadcast(ends), "old_shard")
    target = F.coalesce(F.try_element_at(F.filter("ends", lambda e: F.col("middle") < e["end"]), F.lit(1)), F.element_at("ends", -1))["shard"]
    placed = landed(placed.select("doc_id", "digest", "rows", "size", "text_crc32", "old_shard", "kind", "block", target.alias("shard")), "shard-places")

    # slots: rows in the blocks before, then the row's place in its block
    piece = ["shard", "old_shard", "kind", "block"]
    pieces = placed.groupBy(*piece).agg(F.sum("rows").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("old_shard", "kind", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*piece, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    nth = Window.partitionBy(*piece).orderBy(*in_order).rowsBetween(Window.unboundedPreceding, -1)
    slot = (F.col("start") + F.coalesce(F.sum("rows").over(nth), F.lit(0))).cast("long").alias("slot")
    return placed.join(starts, piece).select("doc_id", "digest", "rows", "size", "text_crc32", "old_shard", "shard", slot)


def per_row(planned: DataFrame) -> DataFrame:
    """One row and one slot for every document row."""
    return planned.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("slot", F.col("slot") + F.col("nth")).drop("nth", "rows")


def resharded(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The documents with ``size``, ``text_crc32``, ``shard``, ``slot`` and ``old_shard``; input columns of these names are replaced."""
    planned = plan(docs, shards, **options).withColumnsRenamed({"doc_id": "id_", "digest": "digest_"})
    rows = keyed(replaced(docs, ADDED))
    met = rows.join(planned, same(rows, planned, {"doc_id": "id_", "digest": "digest_"}))
    nth = met.withColumn("slot", F.col("slot") + occurrence(["doc_id", "digest"]) - 1)
    return nth.select("row.*", "size", "text_crc32", "shard", "slot", "old_shard")


def affected(planned: DataFrame) -> list[int]:
    """The new shards whose files change: they gain or lose a document (one number a shard)."""
    moved = planned.where("shard <> old_shard")
    return sorted(r[0] for r in moved.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct().collect())


MANIFEST = "version int, shard int, folder string"


def _written(sharded: DataFrame, folder: str) -> list[int]:
    """Write a folder per shard; the shards that hold rows."""
    files = sharded.repartition("shard", F.floor(F.col("slot") / FILE_ROWS)).sortWithinPartitions("shard", "slot")
    files.write.mode("overwrite").partitionBy("shard").parquet(folder)
    held = sharded.sparkSession.read.schema(sharded.schema).parquet(folder).select("shard").distinct()
    return sorted(r.shard for r in held.collect())  # one number a shard


def _recorded(spark: SparkSession, path: str, version: int, folders: dict[int, str]) -> None:
    """Add a version to the manifest, a row a shard and one that names the version; this commits it."""
    rows = [(version, None, None), *((version, s, f) for s, f in sorted(folders.items()))]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict[int, str]]:
    table = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    rows = table.collect()  # one row a shard and version
    version = max(r.version for r in rows) if version is None else version
    return version, {r.shard: r.folder for r in rows if r.version == version and r.shard is not None}


def write_shards(sharded: DataFrame, path: str) -> str:
    """Write all shards of a table (with ``shard`` and ``slot``) as version 0 of a new folder ``path``."""
    spark = sharded.sparkSession
    sharded.limit(0).write.parquet(f"{path}/empty")  # the columns, for a table without rows
    folder = f"{path}/version=0"
    _recorded(spark, path, 0, {s: folder for s in _written(sharded, folder)})
    return path


def rewrite(sharded: DataFrame, path: str) -> list[int]:
    """Make ``path`` hold the new shards, by a new version that writes the affected ones only; returns those.

    ``sharded`` may be read from ``path`` itself: its ``old_shard`` is a row's shard there.  The
    other shards hold the rows they held, with the slots and added columns of before.  The
    files of earlier versions stay as they are, so a run that dies leaves the old version, and
    the next run writes over what it left.  A shard that lost all its rows is no longer listed.
    ``read_shards`` reads any version.
    """
    spark = sharded.sparkSession
    version, folders = _manifest(spark, path, None)
    changed = affected(sharded)
    columns = spark.read.parquet(f"{path}/empty").columns
    folder = f"{path}/version={version + 1}"
    held = _written(sharded.where(F.col("shard").isin(changed)).select(*columns), folder)
    kept = {s: f for s, f in folders.items() if s not in changed}
    _recorded(spark, path, version + 1, kept | {s: folder for s in held})
    return changed


def read_shards(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default, from the shards' folders that the manifest names."""
    _, folders = _manifest(spark, path, version)
    empty = spark.read.parquet(f"{path}/empty")
    if not folders:
        return empty
    found = spark.read.schema(empty.schema).option("basePath", path).parquet(*(f"{f}/shard={s}" for s, f in sorted(folders.items())))
    return found.select(*empty.columns)
