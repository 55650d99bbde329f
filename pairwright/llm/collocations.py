"""Phrase mining on a weighted de Bruijn graph of word grams.

Nodes are pairs of words, edges are runs of three: an edge leads from its first two words to
its last two, and weighs as often as the run occurs.  Only edges are counted in the texts,
with corrections for the pairs and words that end a piece.  Everything shorter follows: a
pair occurs as often as its node's edges leave it plus the pieces that end in it, a word as
often as the nodes that begin with it plus the pieces that end in it.  Frequent nodes with
one way in and one way out, all of one weight, are compacted into paths: passages repeated
as a whole.
"""

from collections import defaultdict
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwright.llm.shared import landed

MIN_COUNT = 10
TOP = 2000
SCALE = 1_000_000
SUBSUMED = 50  # percent of a phrase's uses that a longer one must have to replace it
NO_LANG = "und"
ID_BITS, SALT_BITS = 20, 4  # three words and a salt make up a 64-bit key within a task
FLUSH_WORDS = (1 << ID_BITS) - 8  # words a task adds up before it sends their grams on
BATCH_ROWS = 1 << 14
HELD_BYTES = 16 << 20  # packed grams a task merges at a time

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def _pack(lang: str, tokens: list[bytes]) -> pa.RecordBatch:
    """Grams of a run of words, b"" after each piece, added up: one row for each first word and salt."""
    ids = defaultdict(count().__next__, {})
    ids[b""]
    found = np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens))
    a = found[:-2]
    b, c = found[1:-1], found[2:]
    at = a > 0
    a, b, c = a[at], b[at], np.where(b > 0, c, 0)[at]
    salt = np.fromiter((crc32(w) & ((1 << SALT_BITS) - 1) for w in ids), np.uint64, len(ids))
    shift = np.uint64(ID_BITS)
    key = ((a << np.uint64(SALT_BITS) | salt[b]) << shift | b) << shift | c
    key, n = np.unique(key, return_counts=True)
    mask = np.uint64((1 << ID_BITS) - 1)
    words = pa.array(list(ids), pa.string())
    second, third = (words.take(pa.array((x & mask).astype(np.int64))) for x in (key >> shift, key))
    has_third, has_second = (pa.array((x & mask) > 0) for x in (key, key >> shift))
    rest = pc.if_else(has_third, pc.binary_join_element_wise(second, third, " "), pc.if_else(has_second, second, ""))
    rest = pc.if_else(pa.array(n > 1), pc.binary_join_element_wise(rest, pa.array(n).cast(pa.string()), "\t"), rest)
    group = key >> np.uint64(2 * ID_BITS)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(group)), pa.int64()), rest)
    first = words.take(pa.array((group[starts] >> np.uint64(SALT_BITS)).astype(np.int64)))
    salts = pa.array((group[starts] & np.uint64((1 << SALT_BITS) - 1)).astype(np.int32))
    columns = [pa.array([lang] * len(starts), pa.string()), first, salts, pc.binary_join(lists, "\n").cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "first", "salt", "rests"])


def _packed(batches):
    """(lang, first, salt, rests) of a partition's texts, added up as far as ``FLUSH_WORDS`` allows.

    ``rests`` lists what follows the first word, one a line: the other two words of an edge,
    the second word of a pair that ends a piece, nothing for a word that does; a count over
    one stands behind a tab.  ``salt`` follows from the second word, so a node is not split.
    """
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0

    def flush():
        for lang, tokens in held.items():
            tokens.append(b"")
            for at in range(0, len(tokens), FLUSH_WORDS):
                # the two words behind a run close its last grams
                rows = _pack(lang, [*tokens[at : at + FLUSH_WORDS + 2], b"", b""][: FLUSH_WORDS + 2])
                for start in range(0, rows.num_rows, BATCH_ROWS):
                    yield rows.slice(start, BATCH_ROWS)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            tokens = held[NO_LANG if lang is None else lang]
            before = len(tokens)
            for piece in (text or b"").translate(_LOWER).split(b"\n"):
                words = piece.split()  # at spaces and tabs: the other white space parts pieces
                if words:
                    tokens += words
                    tokens.append(b"")
            size += len(tokens) - before
            if size >= FLUSH_WORDS // 4:
                yield from flush()
                size = 0
    yield from flush()


def _counted(rows: pa.Table, whole: np.ndarray, least: int):
    """(lang, first, second, third, n) of packed rows in order; of groups marked ``whole`` pairs and edges below ``least`` are left out."""
    lines = pc.split_pattern(rows["rests"].combine_chunks(), "\n")
    row = np.repeat(np.arange(rows.num_rows), np.diff(lines.offsets.to_numpy()))
    line = lines.flatten()
    parts = pc.split_pattern(line, "\t")
    many = np.diff(parts.offsets.to_numpy()) > 1
    n = np.ones(len(line), np.int64)
    flat, start = parts.flatten(), parts.offsets.to_numpy()[:-1]
    n[many] = flat.take(pa.array(start[many] + 1)).cast(pa.int64()).to_numpy()
    group = _groups(rows)
    grams = pa.table({"group": group[row], "rest": flat.take(pa.array(start)), "n": n}).group_by(["group", "rest"], use_threads=False).aggregate([("n", "sum")])
    words = pc.split_pattern(grams["rest"].combine_chunks(), " ")
    size, start, flat = np.diff(words.offsets.to_numpy()), words.offsets.to_numpy()[:-1], words.flatten()
    n, own = grams["n_sum"].to_numpy(), grams["group"].to_numpy()
    second = flat.take(pa.array(start))  # empty for a word that ends a piece
    pairs = pa.table({"group": own, "second": second, "n": n}).filter(pc.not_equal(second, "")).group_by(["group", "second"], use_threads=False).aggregate([("n", "sum")])
    firsts = pa.table({"group": own, "n": n}).group_by("group", use_threads=False).aggregate([("n", "sum")])
    keep = (size > 1) & ((n >= least) | ~whole[own])
    keep_pairs = (pairs["n_sum"].to_numpy() >= least) | ~whole[pairs["group"].to_numpy()]
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))  # a row of each group
    lang, first = rows["lang"].combine_chunks(), rows["first"].combine_chunks()

    def out(groups, second, third, n):
        here = pa.array(at[groups])
        none = pa.nulls(len(groups), pa.string())
        return pa.RecordBatch.from_arrays([lang.take(here), first.take(here), none if second is None else second, none if third is None else third, pa.array(n, pa.int64())], names=["lang", "first", "second", "third", "n"])

    yield out(firsts["group"].to_numpy(), None, None, firsts["n_sum"].to_numpy())
    kept = pairs.filter(pa.array(keep_pairs))
    yield out(kept["group"].to_numpy(), kept["second"].combine_chunks(), None, kept["n_sum"].to_numpy())
    yield out(own[keep], second.filter(pa.array(keep)), flat.take(pa.array(start[keep] + 1)), n[keep])


def _groups(rows: pa.Table) -> np.ndarray:
    """0, 1, … for runs of equal (lang, first, salt)."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    changed = np.zeros(rows.num_rows, bool)
    for c in ("lang", "first", "salt"):
        column = rows[c].combine_chunks()
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(changed)


def _merged(least: int):
    """Merge a partition's packed rows, which come in order; a group beyond ``HELD_BYTES`` goes on in parts, unfiltered."""

    def merge(batches):
        held, size, cut = [], 0, False  # cut: a part of the first held group has gone on already

        def go_on(last: bool):
            nonlocal held, size, cut
            rows = pa.Table.from_batches(held).combine_chunks()
            group = _groups(rows)
            if not len(group):
                return
            whole = np.ones(group[-1] + 1, bool)
            whole[0] = not cut
            stay = 0 if last else int((group == group[-1]).sum())
            if stay == len(group):  # one large group
                whole[:], stay = False, 0
                cut = True
            elif not last:
                cut = False
            held = rows.slice(rows.num_rows - stay).to_batches() if stay else []
            size = sum(b.nbytes for b in held)
            yield from _counted(rows.slice(0, rows.num_rows - stay), whole, least)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= HELD_BYTES:
                    yield from go_on(False)
        if held:
            yield from go_on(True)

    return merge


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(``lang``, ``first``, ``second``, ``third``, ``n``): every word, and the pairs and runs of three with ``least`` uses.

    A null ``second`` marks a word, a null ``third`` a pair.
    """
    read = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sent = read.mapInArrow(_packed, "lang string, first string, salt int, rests string")
    key = ["lang", "first", "salt"]
    parts = sent.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merged(least), "lang string, first string, second string, third string, n long")
    return parts.groupBy("lang", "first", "second", "third").agg(F.sum("n").alias("n")).where(F.col("second").isNull() | (F.col("n") >= least))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers of up to 38 digits."""
    whole = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * whole(a, 15) * whole(a, 15), whole(left, 15) * whole(right, 15))


def unary_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(``lang``, ``edge``, ``head``, ``place``): the path of every edge, named by its first edge, and the edge's place on it from 0.

    A path goes on through a node whose only edges are one in and one out, both of the
    node's own weight.  As every piece enters and leaves the graph somewhere, such a path
    has a first edge.
    """
    node = pairs.select("lang", F.concat_ws(" ", "first", "second").alias("node"), F.col("n").alias("flow"))
    named = edges.select("lang", _edge().alias("edge"), F.concat_ws(" ", "first", "second").alias("tail"), F.concat_ws(" ", "second", "third").alias("node"), "n")
    inward = named.select("lang", "node", "n", F.col("edge").alias("up")).join(node, ["lang", "node"]).where("n = flow").select("lang", "node", "up", "flow")
    onward = named.select("lang", F.col("tail").alias("node"), "n", "edge").join(inward, ["lang", "node"]).where("n = flow")
    steps = landed(onward.select("lang", "edge", "up", F.lit(1).cast("long").alias("place")), "path-steps")
    while True:  # doubles the distance that is known, so as many rounds as the longest path has binary digits
        further = steps.select("lang", F.col("edge").alias("up"), F.col("up").alias("top"), F.col("place").alias("more"))
        steps = landed(
            steps.join(further, ["lang", "up"], "left").select("lang", "edge", F.coalesce("top", "up").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("top").isNotNull().alias("moved")),
            "path-steps",
        )
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    heads = named.join(steps, ["lang", "edge"], "left")
    return heads.select("lang", "edge", F.coalesce("up", "edge").alias("head"), F.coalesce("place", F.lit(0)).alias("place"), "n")


def passages(paths: DataFrame) -> DataFrame:
    """(``lang``, ``passage``, ``words``, ``n``): the compacted paths as texts; none is longer than a piece of a text."""
    found = paths.groupBy("lang", "head").agg(F.sort_array(F.collect_list(F.struct("place", F.substring_index("edge", " ", -1).alias("word")))).alias("on"), F.max("n").alias("n"))
    rest = F.expr("transform(slice(on, 2, greatest(size(on) - 1, 0)), x -> x.word)")
    return found.select("lang", F.concat_ws(" ", F.array(F.col("head")), rest).alias("passage"), (F.size("on") + 2).cast("long").alias("words"), "n")


def _edge() -> Column:
    return F.concat_ws(" ", "first", "second", "third")


def candidates(counts: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a``, ``l``, ``r``, ``score``, ``path_words`` of all phrases that no longer one replaces."""
    words = counts.where(F.col("second").isNull() & (F.col("n") >= least))
    pairs = counts.where("second IS NOT NULL AND third IS NULL")
    edges = counts.where("third IS NOT NULL")
    word = lambda name, column: words.select("lang", F.col("first").alias(name), F.col("n").alias(column))
    # frequent longer phrases replace the pairs they hold
    held = edges.select("lang", "first", "second", "n").union(edges.select("lang", "second", "third", "n"))
    longest = held.groupBy("lang", "first", "second").agg(F.max("n").alias("longer"))
    open_pairs = pairs.drop("third").join(longest, ["lang", "first", "second"], "left").where(f"longer IS NULL OR 100 * longer < {SUBSUMED} * n")
    two = open_pairs.join(word("first", "l"), ["lang", "first"]).join(word("second", "r"), ["lang", "second"])
    two = two.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), F.lit(2).alias("words"), F.col("n").alias("a"), "l", "r", score(F.col("n"), F.col("l"), F.col("r")).alias("score"), F.lit(None).cast("long").alias("path_words"))
    flow = pairs.drop("third")
    three = (
        edges.join(flow.select("lang", "first", "second", F.col("n").alias("l2")), ["lang", "first", "second"])
        .join(flow.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("n").alias("r1")), ["lang", "second", "third"])
        .join(word("first", "l1"), ["lang", "first"]).join(word("third", "r2"), ["lang", "third"])
    )
    three = three.withColumns({"s1": score(F.col("n"), F.col("l1"), F.col("r1")), "s2": score(F.col("n"), F.col("l2"), F.col("r2")), "edge": _edge()})
    second_cut = F.col("s2") < F.col("s1")
    paths = unary_paths(pairs, edges)
    lengths = paths.groupBy("lang", "head").agg((F.count(F.lit(1)) + 2).alias("path_words"))
    three = three.join(paths.select("lang", "edge", "head").join(lengths, ["lang", "head"]).drop("head"), ["lang", "edge"])
    three = three.select(
        "lang", F.col("edge").alias("phrase"), F.lit(3).alias("words"), F.col("n").alias("a"), F.when(second_cut, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second_cut, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"), F.col("path_words").cast("long").alias("path_words"),
    )
    return two.union(three)


def top_phrases(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``path_words``.

    ``path_words`` is the length of the repeated passage (compacted path) that a phrase of
    three words lies on.  A null language is "und"; null, empty and wordless texts have no
    pieces; repeated rows count each; other columns are not read; an empty table gives no
    rows.
    """
    counts = landed(phrase_counts(docs, least), "phrase-counts")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = candidates(counts, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("second IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    met = best.join(total, "lang")
    return met.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "path_words")
