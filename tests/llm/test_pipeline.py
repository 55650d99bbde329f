"""The pipeline end to end against plain readings of its stages, and each stage on odd rows."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as pipeline
from pairwright.llm import resharding
from tests.llm.test_corpus import DOC, ODD, brute_contamination, docs_of

SF = "/root/testdata/sf0.001"
COLUMNS = [c.split()[0] for c in DOC.split(", ")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def one_of_each(rows):
    """The smallest id of every group of texts that are alike, by way of others too."""
    sets = {}
    for doc_id, text in rows:
        w = words(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[a] != low[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return set(low.values())


def test_run_equals_the_stages_read_plainly(spark, tmp_path):
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    long = next(t for _, t in items if len(words(t)) >= 12)
    first = next(r for r in docs if len(words(r[1])) >= 100)
    planted = [
        (90_001, first[1], first[2], first[3], first[4]),  # an exact copy
        (90_002, first[1] + " tail", first[2], first[3], first[4]),  # a near copy
        (90_003, docs[3][1] + " " + long, docs[3][2], docs[3][3], 0),  # a benchmark passage
    ]
    rows = docs + planted
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    accepted = [r.doc_id for r in pipeline.named_language(spark, table, str(tmp_path)).collect()]
    assert len(accepted) >= 0.9 * len(rows)
    texts = {r[0]: r[1] for r in rows}
    kept = one_of_each([(d, texts[d]) for d in accepted])
    dirty = {r[0] for r in brute_contamination([r for r in rows if r[0] in kept], items) if r[2]}
    clean = kept - dirty
    assert 90_003 in dirty or 90_003 not in kept
    assert 90_001 not in kept and 90_002 not in kept and first[0] in kept

    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == [*COLUMNS, *resharding.ADDED]
    got = got.collect()
    assert {r.doc_id for r in got} <= clean
    assert all(r.text == texts[r.doc_id] for r in got)
    # the mix: one and a half times all sizes in all, no document more than twice
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", texts[d])) for d in clean}
    assert max(Counter(r.doc_id for r in got).values()) <= 2
    assert sum(size[r.doc_id] for r in got) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    # the shards: gapless slots, bytes near equal
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    assert set(shards) <= set(range(40))


@pytest.fixture
def benchmark_of(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, None), (None, "three four"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_on_odd_rows(spark, benchmark_of, stage):
    odd = docs_of(spark, ODD)
    last = stage is pipeline.STAGES[-1][1]
    columns = [*COLUMNS, *resharding.ADDED] if last else COLUMNS
    found = stage(spark, odd, benchmark_of)
    assert found.columns == columns
    rows = [tuple(r)[: len(COLUMNS)] for r in found.collect()]
    assert set(rows) <= set(ODD)
    wanted = {"decontaminate": [r for r in ODD if r[1] not in ("one two", "three four")], "shard": ODD}.get(stage.__name__)
    if wanted is not None:
        assert sorted(rows, key=str) == sorted(wanted, key=str)
    assert stage(spark, spark.createDataFrame([], DOC), benchmark_of).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES[:-1]], ids=[n for n, _ in pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns(spark, benchmark_of, stage):
    from pyspark.sql import functions as F

    names = "row digest size l accepted copies n_hit nth id_ p".split()
    clashing = docs_of(spark, ODD).select("*", *(F.lit("own").alias(n) for n in names))
    found = stage(spark, clashing, benchmark_of)
    assert found.columns == clashing.columns
    assert all(r[n] == "own" for r in found.collect() for n in names)
