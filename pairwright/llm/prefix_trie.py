"""Prefix trie of conversations by truncation peeling.

Equal sequences of turns are one distinct sequence.  From the deepest level up, the nodes that
survive a level meet the sequences that end on it, are regrouped, and lose their last turn:
a node's figures are complete when its level is reached, and its parents are found by
stripping.  A tail of turns that no other sequence enters has nothing to merge with and is
peeled in one step, so there is one job per level that sequences share.

Turns are rows, never gathered by conversation: a turn's place in its conversation and the
hash of all turns up to it are running values over rows in range-partitioned order, carried
from partition to partition.  The hash is a polynomial over 128-bit turn hashes, so the parts
of a conversation that lie in different partitions can be put together.  Nodes carry at most
``BLOCK`` of the turns above them; longer paths are fetched block by block.
"""

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pairwright.llm.shared import landed

MODULUS = (1 << 127) - 1
BASE = 0x5A0F3C1B9E7D2846A1C3E5F708192B4D  # of the polynomial, below the modulus
ROOT = bytes(16)  # key of the node without turns
HEAD_TURNS = 9  # rebuilding takes 0 to 8 turns
FAMILY = 5
BLOCK = 16
ID_BITS = 9  # conversation ids are joined in runs of 512 before they are hashed
EMPTY_SHA = hashlib.sha256().hexdigest()


def _join(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """(turns, hash, bytes) of two parts in a row."""
    return a[0] + b[0], (a[1] * pow(BASE, b[0], MODULUS) + b[1]) % MODULUS, a[2] + b[2]


def _scan(batches):
    """Running (depth, key, bytes) of a partition's rows, which come in order."""
    part = TaskContext.get().partitionId()
    conv, depth, key, total = None, 0, 0, 0
    for batch in batches:
        convs, hashes, sizes = (batch[c].to_pylist() for c in ("conv_id", "hash", "bytes"))
        depths, keys, totals = [], [], []
        for c, h, n in zip(convs, hashes, sizes, strict=True):
            if c != conv:
                conv, depth, key, total = c, 0, 0, 0
            depth, key, total = depth + 1, (key * BASE + int.from_bytes(h) % MODULUS + 1) % MODULUS, total + n
            depths.append(depth)
            keys.append(key.to_bytes(16))
            totals.append(total)
        columns = [batch["conv_id"], batch["hash"], batch["bytes"], pa.array([part] * len(convs), pa.int32()), pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(totals, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "hash", "bytes", "part", "depth", "key", "total"])


def _carried(carry: dict[tuple[int, int], tuple[int, int, int]]):
    """Add what lies in the partitions before, and the key of the turn before."""

    def carried(batches):
        for batch in batches:
            convs, parts, depths, keys, totals = (batch[c].to_pylist() for c in ("conv_id", "part", "depth", "key", "total"))
            hashes = batch["hash"].to_pylist()
            unroll = pow(BASE, -1, MODULUS)
            parents = []
            for i, at in enumerate(zip(convs, parts, strict=True)):
                n, key = depths[i], int.from_bytes(keys[i])
                if at in carry:
                    n, key, totals[i] = _join(carry[at], (n, key, totals[i]))
                    depths[i], keys[i] = n, key.to_bytes(16)
                before = (key - int.from_bytes(hashes[i]) % MODULUS - 1) * unroll % MODULUS
                parents.append(before.to_bytes(16) if n > 1 else ROOT)
            columns = [batch["conv_id"], batch["hash"], batch["bytes"], pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "hash", "bytes", "depth", "key", "parent", "total"])

    return carried


def running(turns: DataFrame, order: list[str], name: str) -> DataFrame:
    """``conv_id``, ``hash``, ``bytes``, ``depth`` (from 1), ``key``, ``parent``, ``total`` (bytes so far) of (conv_id, hash, bytes, order columns).

    The rows of a conversation may lie in any number of partitions.  What is carried over
    goes through the driver: two rows for each partition boundary at most.
    """
    by = ["conv_id", *order]
    ordered = turns.repartitionByRange(*by).sortWithinPartitions(*by)
    kind = "conv_id long, hash binary, bytes long, part int, depth long, key binary, total long"
    local = landed(ordered.mapInArrow(_scan, kind), f"{name}-local")
    cut = local.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv_id")
    last = local.join(F.broadcast(cut), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.max(F.struct("depth", "key", "total")).alias("all"))
    carry, so_far = {}, {}
    for row in sorted(last.collect(), key=lambda r: (r.conv_id, r.part)):
        before = so_far.get(row.conv_id, (0, 0, 0))
        carry[row.conv_id, row.part] = before
        so_far[row.conv_id] = _join(before, (row["all"].depth, int.from_bytes(row["all"].key), row["all"].total))
    return landed(local.mapInArrow(_carried(carry), "conv_id long, hash binary, bytes long, depth long, key binary, parent binary, total long"), name)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``hash``, ``bytes``: null role or text is empty; rows without conv_id belong to no conversation."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), mark.alias("hash"), F.octet_length(text).cast("long").alias("bytes"))


def taken_turns(conv_id: Column) -> Column:
    """How many turns of the family's first conversation a rebuilt one begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD_TURNS).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: ``conv_id``; their rebuilt turns: ``conv_id``, ``hash``, ``bytes``, ``own``, ``at`` in the order of the last two)."""
    placed = running(turns, ["turn", "hash"], "trie-turns").select("conv_id", F.col("depth").alias("at"), "hash", "bytes")
    convs = landed(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", taken_turns(F.col("conv_id")).alias("taken")), "trie-conversations")
    # at most 8 turns of each family's first conversation
    head = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEAD_TURNS)).groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct("at", "hash", "bytes"))).alias("head"))
    begun = convs.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(head, "family")
    begun = begun.select("conv_id", "taken", F.explode("head").alias("t")).where("t.at <= taken").select("conv_id", "t.hash", "t.bytes", F.lit(0).alias("own"), "t.at")
    own = placed.where(F.col("at") > taken_turns(F.col("conv_id"))).select("conv_id", "hash", "bytes", F.lit(1).alias("own"), "at")
    return convs.select("conv_id"), begun.union(own)


def _digests(batches):
    """SHA-256 of the runs of ids of each key, which come in order; holds one run at a time."""
    key, sha, same, n, out = None, None, None, 0, []

    def row():
        return {"key": key, **same, "n": n, "ends": sha.hexdigest()}

    kind = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("total", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    for batch in batches:
        for k, ids, depth, total, low, count in zip(*(batch[c].to_pylist() for c in ("key", "ids", "depth", "total", "low", "count")), strict=True):
            if k != key:
                if key is not None:
                    out.append(row())
                key, sha, same, n = k, hashlib.sha256(), {"depth": depth, "total": total, "first": low}, 0
            else:
                sha.update(b",")
            sha.update(ids.encode())
            n += count
        yield pa.RecordBatch.from_pylist(out, kind)
        out = []
    if key is not None:
        yield pa.RecordBatch.from_pylist([row()], kind)


def distinct_sequences(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """``key``, ``depth``, ``total``, ``first`` (smallest conversation), ``n``, ``ends`` of every distinct sequence, the empty one included."""
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "key", "total")).alias("l"))
    ended = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("l.key", F.lit(ROOT)).alias("key"), F.coalesce("l.depth", F.lit(0)).alias("depth"), F.coalesce("l.total", F.lit(0)).alias("total"))
    runs = ended.groupBy("key", F.shiftright("conv_id", ID_BITS).alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
        F.max("depth").cast("long").alias("depth"), F.max("total").cast("long").alias("total"), F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("count"),
    )
    digests = runs.repartition("key").sortWithinPartitions("key", "run").mapInArrow(_digests, "key binary, depth long, total long, first long, n long, ends string")
    return landed(digests, "trie-sequences")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` are the ordered (``own``, ``at``) turns of ``convs``; a conversation without
    turns ends at the root.  Without conversations there is no node.
    """
    steps = running(turns, ["own", "at"], "trie-steps")
    seqs = distinct_sequences(convs, steps)
    named = seqs.select(F.col("first").alias("conv_id"), F.col("key").alias("seq"), F.col("depth").alias("end"), F.col("total").alias("whole"), "n", "ends")
    own = landed(steps.join(named, "conv_id"), "trie-paths")  # turns of the first conversation of each sequence
    # nodes that one sequence alone enters make up its tail
    entered = own.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("seq").alias("seq"), F.min("depth").alias("depth")).where("times = 1")
    tails = entered.groupBy("seq").agg(F.min("depth").alias("top"))
    shared = named.join(tails, "seq", "left").select("conv_id", "seq", "end", "whole", "n", "ends", (F.coalesce("top", F.col("end") + 1) - 1).alias("upto"))
    shared = landed(shared, "trie-shared")
    bound = own.join(shared.select("seq", "upto"), "seq")
    tail = bound.where("depth > upto")
    rest = F.col("whole") - F.col("total") + F.col("bytes")
    private = landed(
        tail.select(
            "key", "parent", "depth", F.col("conv_id").alias("first"), F.col("n").alias("n_convs"), (F.col("depth") < F.col("end")).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * rest).alias("saved"), F.when(F.col("depth") == F.col("end"), F.col("ends")).alias("ends"), (F.col("depth") == F.col("upto") + 1).alias("top"),
        ),
        "trie-tails",
    )
    # the shared turns in blocks, the last of each first
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    blocks = bound.where("depth <= upto").groupBy("seq", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "key", "parent", "bytes"))).alias("path"))
    blocks = landed(blocks, "trie-blocks")
    last = F.floor((F.col("upto") - 1) / BLOCK).cast("long")
    saved = tail.where("depth = upto + 1").select("seq", ((F.col("n") - 1) * rest).alias("tail_saved"))
    entering = shared.withColumn("block", last).join(blocks, ["seq", "block"], "left").join(saved, "seq", "left").select(
        "upto", F.coalesce(F.element_at("path", -1)["key"], F.lit(ROOT)).alias("key"), "path", "seq", F.col("conv_id").alias("first"), "n",
        (F.col("end") > F.col("upto")).cast("long").alias("kids"), (F.col("end") > F.col("upto")).cast("long").alias("leaves"),
        F.coalesce("tail_saved", F.lit(0)).alias("saved"), F.when(F.col("end") == F.col("upto"), F.col("ends")).alias("ends"),
    )
    entering = landed(entering, "trie-entering")
    deepest = entering.agg(F.max("upto")).first()[0]
    if deepest is None:
        return _named(private.where("false"), private)
    alive, levels = None, []
    for depth in range(deepest, -1, -1):
        here = entering.where(F.col("upto") == depth).drop("upto")
        if alive is not None:
            if depth and depth % BLOCK == 0:
                back = blocks.where(F.col("block") == depth // BLOCK - 1).select("seq", "path")
                alive = alive.drop("path").join(back, "seq")
            up = F.element_at("path", -1)["key"] if depth else F.lit(ROOT)
            here = here.union(alive.select(up.alias("key"), "path", "seq", "first", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved", F.lit(None).cast("string").alias("ends")))
        level = landed(_level(here, depth), f"trie-level-{depth}")
        levels.append(level)
        alive = level.select(F.expr("slice(path, 1, greatest(size(path) - 1, 0))").alias("path"), "seq", "first", "n", "leaves", "saved")
    peeled = levels[0]
    for level in levels[1:]:
        peeled = peeled.union(level)
    peeled = peeled.select("key", "parent", "depth", "first", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), "saved", "ends", F.lit(True).alias("top"))
    return _named(peeled, private)


def _level(here: DataFrame, depth: int) -> DataFrame:
    """The nodes of one level, whole."""
    any_path = F.max(F.struct("seq", "path"))
    found = here.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), any_path.alias("one")
    )
    size = F.element_at("one.path", -1)["bytes"] if depth else F.lit(0).cast("long")
    up = F.element_at("one.path", -1)["parent"] if depth else F.lit(None).cast("binary")
    return found.select(
        "key", up.alias("parent"), F.lit(depth).cast("long").alias("depth"), "first", "n", "kids",
        F.greatest("leaves", F.lit(1)).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * size).alias("saved"), "ends", "one.seq", "one.path",
    )


def _named(peeled: DataFrame, private: DataFrame) -> DataFrame:
    """Nodes with their parents' conversations: below the top of a tail it is the tail's own."""
    parents = peeled.select(F.col("key").alias("parent"), F.col("first").alias("parent_conv_id"))
    met = peeled.union(private.where("top")).join(parents, "parent", "left")
    inner = private.where("NOT top").withColumn("parent_conv_id", F.col("first"))
    columns = [
        F.col("first").alias("conv_id"), F.col("depth"), F.col("parent_conv_id"), F.col("n_convs"), F.col("n_children"), F.col("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    ]
    return met.select(columns).union(inner.select(columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations.

    Turns come in the order of ``turn`` (null first); of equal turn numbers in the order of
    a hash of role and text, so repeated rows stay turns of their own, side by side.  Rows
    without ``conv_id`` belong to no conversation; other columns are not read; an empty
    table has no node, not even a root.
    """
    return trie(*rebuilt(turn_rows(conversations)))
