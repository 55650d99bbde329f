"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

The reference table counts, for every line key, the documents that hold it; keys are 128-bit
hashes.  Every shard of keys has a cuckoo filter of those that reached ``min_docs`` and the
list of its false positives among all other counted keys, so a lookup in filter and list is
exact for every counted document.  Inserting or deleting documents changes the counts, and
the filters by just the keys that crossed the threshold.
"""

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairwright.llm.shared import landed, replaced, same

SPACE = b" \t\n\x0b\x0c\r"
MIN_DOCS, MIN_CHARS = 10, 1
SHARD_KEYS, LEAST_SHARDS = 65_536, 64
BROADCAST_BYTES = 32 * 1024 * 1024
GROUP_LINES = 500_000
SLOTS, KICKS = 4, 500


class Cuckoo:
    """A cuckoo filter with 32-bit fingerprints, four to a bucket; takes the keys as arrays of two 64-bit halves."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> "Cuckoo":
        return cls(np.zeros((1 << max(1, int(keys / SLOTS / 0.9)).bit_length(), SLOTS), np.uint32))

    @staticmethod
    def places(hi: np.ndarray, lo: np.ndarray, mask: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets."""
        print_ = (lo.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)
        print_[print_ == 0] = 1
        one = lo.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        other = one ^ ((print_.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF))
        mask = np.asarray(mask, np.uint64)
        return print_, (one & mask).astype(np.int64), (other & mask).astype(np.int64)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if the filter is too full for all of them."""
        mask = len(self.table) - 1
        rng = np.random.default_rng(5)
        for print_, one, two in zip(*self.places(hi, lo, mask), strict=True):
            at = one
            for _ in range(KICKS):
                free = np.flatnonzero(self.table[at] == 0)
                if not len(free) and at == one:
                    free, at = np.flatnonzero(self.table[two] == 0), two
                if len(free):
                    self.table[at, free[0]] = print_
                    break
                slot = rng.integers(SLOTS)
                print_, self.table[at, slot] = self.table[at, slot], print_
                at = int(at ^ (int(print_) * 0x9E3779B1 & 0xFFFFFFFF & mask))
                one = -1
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Only of keys that were inserted."""
        for print_, *both in zip(*self.places(hi, lo, len(self.table) - 1), strict=True):
            for at in both:
                if len(held := np.flatnonzero(self.table[at] == print_)):
                    self.table[at, held[0]] = 0
                    break

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(hi, lo, len(self.table) - 1)
        return ((self.table[one] == print_[:, None]) | (self.table[two] == print_[:, None])).any(axis=1)


class Probe:
    """The filters and false-positive lists of several shards, asked for many keys at once."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], shards: int):
        self.shards = shards
        self.base, self.mask = np.zeros(shards, np.int64), np.zeros(shards, np.uint64)
        tables, at, listed = [np.zeros((1, SLOTS), np.uint32)], 1, []  # bucket 0 is empty: for shards without a filter
        for shard, table, wrong in rows:
            table = np.frombuffer(table, "<u4").reshape(-1, SLOTS)
            self.base[shard], self.mask[shard] = at, len(table) - 1
            tables.append(table)
            at += len(table)
            listed.append(np.frombuffer(wrong, "<i8").reshape(-1, 2))
        self.table = np.concatenate(tables)
        self.wrong = {tuple(k) for k in np.concatenate(listed).tolist()} if listed else set()

    def __call__(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shard = hi & (self.shards - 1)
        print_, one, two = Cuckoo.places(hi, lo, self.mask[shard])
        found = ((self.table[self.base[shard] + one] == print_[:, None]) | (self.table[self.base[shard] + two] == print_[:, None])).any(axis=1)
        if self.wrong:
            for i in np.flatnonzero(found):
                found[i] = (int(hi[i]), int(lo[i])) not in self.wrong
        return found


def line_keys(data: bytes) -> list[bytes]:
    """The key of every line: A-Z lower-cased, ASCII space stripped at both ends."""
    return [line.strip(SPACE) for line in data.lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def _bytes(texts: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def document_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(``hi``, ``lo``, ``refs``): documents per line key; keys under ``min_chars`` code points are left out."""

    def keys(batches):
        for batch in batches:
            found = []
            for data in _bytes(batch.column(0)):
                found.extend(k for k in set(line_keys(data or b"")) if _long_enough(k, min_chars))
            if found:
                hi, lo = hashes(found)
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

    return docs.select("text").mapInArrow(keys, "hi long, lo long").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"))


@dataclass(frozen=True)
class LineState:
    """Exact reference counts and the filters made from them."""

    refs: DataFrame  # hi, lo, refs
    filters: DataFrame  # shard, filter, wrong
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    shard_keys: int = SHARD_KEYS


def _refreshed(held: pa.Table | None, keys: pa.Table, min_docs: int) -> pa.Table:
    """One shard's filter: the old one changed by the keys that crossed the threshold, or a new one."""
    hi, lo, refs, before = (keys[c].to_numpy() for c in ("hi", "lo", "refs", "before"))
    now, was = refs >= min_docs, before >= min_docs
    full = True
    if held is not None and len(held):
        cuckoo = Cuckoo(np.frombuffer(held["filter"][0].as_py(), "<u4").reshape(-1, SLOTS).copy())
        cuckoo.delete(hi[was & ~now], lo[was & ~now])
        full = not cuckoo.insert(hi[now & ~was], lo[now & ~was])
    spare = 1
    while full:
        cuckoo = Cuckoo.sized(int(now.sum()) * spare)
        full, spare = not cuckoo.insert(hi[now], lo[now]), spare * 2
    wrong = ~now & (refs > 0) & cuckoo.contains(hi, lo)
    shard = int(hi[0]) & (keys["shards"][0].as_py() - 1)
    return pa.table({
        "shard": pa.array([shard], pa.int64()), "filter": pa.array([cuckoo.table.astype("<u4").tobytes()], pa.binary()),
        "wrong": pa.array([np.stack([hi[wrong], lo[wrong]], axis=1).astype("<i8").tobytes()], pa.binary()),
    })


FILTERS = "shard long, filter binary, wrong binary"


def _shard(shards: int):
    return F.col("hi").bitwiseAND(F.lit(shards - 1))


def build(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineState:
    """Count all lines of ``docs`` and make the filters; an empty table gives an empty state that can be inserted into."""
    refs = landed(document_counts(docs, min_chars), "line-refs")
    shards = _shards_for(refs.count(), shard_keys)
    return LineState(refs, _new_filters(refs, shards, min_docs), shards, min_docs, min_chars, shard_keys)


def _shards_for(keys: int, shard_keys: int) -> int:
    return max(LEAST_SHARDS, 1 << (keys // shard_keys).bit_length())


def _new_filters(refs: DataFrame, shards: int, min_docs: int) -> DataFrame:
    keys = refs.withColumns({"before": F.lit(0).cast("long"), "shard": _shard(shards), "shards": F.lit(shards)})
    return landed(keys.groupBy("shard").applyInArrow(lambda t: _refreshed(None, t, min_docs), FILTERS), "line-filters")


def _changed(state: LineState, docs: DataFrame, sign: int) -> LineState:
    delta = document_counts(docs, state.min_chars).select("hi", "lo", (F.col("refs") * sign).alias("delta"))
    both = state.refs.select("hi", "lo", F.col("refs").alias("before"), F.lit(0).cast("long").alias("delta")).unionByName(delta.withColumn("before", F.lit(0).cast("long")))
    counted = landed(both.groupBy("hi", "lo").agg(F.sum("before").alias("before"), (F.sum("before") + F.sum("delta")).alias("refs")), "line-counts")
    if sign < 0 and not counted.where("refs < 0").isEmpty():
        raise ValueError("documents to delete hold lines that the state never counted so often")
    refs, min_docs = counted.where("refs > 0").select("hi", "lo", "refs"), state.min_docs
    shards = _shards_for(refs.count(), state.shard_keys)
    if shards > state.shards:  # the shards split: a filter holds no keys to deal out, so all are made anew
        return replace(state, refs=refs, filters=_new_filters(refs, shards, min_docs), shards=shards)
    keys = counted.withColumns({"shard": _shard(state.shards), "shards": F.lit(state.shards)})
    old = state.filters.groupBy("shard")
    filters = old.cogroup(keys.groupBy("shard")).applyInArrow(lambda held, t: _refreshed(held, t, min_docs) if len(t) else held, FILTERS)
    return replace(state, refs=refs, filters=landed(filters, "line-filters"))


def insert(state: LineState, docs: DataFrame) -> LineState:
    """Count further documents; must come before their ``drop_lines``.

    The number of shards doubles as often as the keys need it, so a state that began empty
    keeps as many keys a shard as one built at once.
    """
    return _changed(state, docs, 1)


def delete(state: LineState, docs: DataFrame) -> LineState:
    """Take back documents that were inserted: the state is as if they had never come.

    Documents with lines that the state does not hold (so often) are an error.
    """
    return _changed(state, docs, -1)


def _kept(data: bytes | None, dropped: list[int] | np.ndarray) -> tuple[int, int, bytes]:
    lines = (data or b"").split(b"\n")
    gone = set(int(i) for i in dropped)
    return len(lines), len(gone), b"\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else (data or b"")


def _dropped(texts: list[bytes | None], probe: Probe, min_chars: int) -> list[np.ndarray]:
    """Per text the positions of its dropped lines."""
    keys = [line_keys(t or b"") for t in texts]
    flat = [k for own in keys for k in own]
    hi, lo = hashes(flat)
    gone = probe(hi, lo)
    for i in np.flatnonzero(gone):
        gone[i] = _long_enough(flat[i], min_chars)
    return [np.flatnonzero(part) for part in np.split(gone, np.cumsum([len(k) for k in keys])[:-1])]


ADDED = ["n_lines", "n_dropped", "kept_text"]


def drop_lines(state: LineState, docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``n_lines``, ``n_dropped`` and ``kept_text``; ``docs`` must have been counted in ``state``.

    A line goes from every document once its key is held by ``min_docs`` documents.  A null
    or empty text is one empty line; repeated rows count as documents of their own; input
    columns of the added names are replaced.  The filters are sent to the tasks while they
    fit ``broadcast_bytes``; beyond that the line hashes travel to the filters' shards, and
    only positions come back.
    """
    docs = replaced(docs, ADDED)
    size = state.filters.agg(F.sum(F.octet_length("filter") + F.octet_length("wrong"))).first()[0] or 0
    min_chars, shards = state.min_chars, state.shards
    kind = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit("").alias("kept_text")).schema
    if size <= broadcast_bytes:
        table = state.filters.toArrow()
        held = docs.sparkSession.sparkContext.broadcast(list(zip(*(table[c].to_pylist() for c in ("shard", "filter", "wrong")), strict=True)))

        def clean(batches):
            probe = Probe(held.value, shards)
            for batch in batches:
                texts = _bytes(batch["text"])
                yield _with_kept(batch, texts, _dropped(texts, probe, min_chars) if texts else [])

        return docs.mapInArrow(clean, kind)
    return _routed(state, docs, kind)


def _with_kept(batch: pa.RecordBatch, texts: list[bytes | None], dropped: list) -> pa.RecordBatch:
    kept = [_kept(t, d) for t, d in zip(texts, dropped, strict=True)]
    columns = [pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *ADDED])


def _routed(state: LineState, docs: DataFrame, kind) -> DataFrame:
    min_chars, shards = state.min_chars, state.shards

    def lines(batches):
        for batch in batches:
            for start in range(0, batch.num_rows):
                keys = line_keys(_bytes(batch["text"].slice(start, 1))[0] or b"")
                long = [i for i, k in enumerate(keys) if _long_enough(k, min_chars)]
                if long:
                    hi, lo = hashes([keys[i] for i in long])
                    own = batch.slice(start, 1).select(["doc_id", "digest"]).take(pa.array(np.zeros(len(long), np.int64)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.array(long, np.int64)), pa.array(hi), pa.array(lo)], names=["doc_id", "digest", "at", "hi", "lo"])

    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").dropDuplicates(["doc_id", "digest"])
    sent = landed(source.mapInArrow(lines, "doc_id string, digest long, at long, hi long, lo long").withColumn("shard", _shard(shards)), "line-routes")
    # a shard with a hot line is dealt out over as many groups as it needs
    parts = sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / GROUP_LINES).alias("parts"))
    filters = state.filters.join(parts, "shard").select("shard", "filter", "wrong", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    spread = sent.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.col("parts"))).drop("parts")

    def ask(held: pa.Table, group: pa.Table) -> pa.Table:
        if not len(group) or not len(held):
            return group.select(["doc_id", "digest", "at"]).slice(0, 0)
        probe = Probe([(held["shard"][0].as_py(), held["filter"][0].as_py(), held["wrong"][0].as_py())], shards)
        return group.select(["doc_id", "digest", "at"]).filter(pa.array(probe(group["hi"].to_numpy(), group["lo"].to_numpy())))

    gone = filters.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(ask, "doc_id string, digest long, at long")
    gone = gone.groupBy(F.col("doc_id").alias("id_"), F.col("digest").alias("digest_")).agg(F.collect_list("at").alias("gone_"))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("digest"))
    met = rows.join(gone, same(rows, gone, {"doc_id": "id_", "digest": "digest_"}), "left").select("row.*", "gone_")

    def clean(batches):
        for batch in batches:
            dropped = [d or [] for d in batch["gone_"].to_pylist()]
            yield _with_kept(batch.drop_columns(["gone_"]), _bytes(batch["text"]), dropped)

    return met.mapInArrow(clean, kind)


def kept_digest(text) -> "F.Column":
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


