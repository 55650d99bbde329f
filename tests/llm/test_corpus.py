"""Each corpus operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairwright.llm import decontamination, language, license_scan, line_dedup, mixing, resharding, simhash, toxicity, url_filter, vector_dedup
from pairwright.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: a null in every column, an empty and a blank text, ties, a repeated row, a long text
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "one two", "en", "b", 7), (5, "one two", "en", "b", 7),
    (5, "one two", "en", "b", 7), (None, "three four", "de", "b", 9), (None, None, None, None, None), (6, "word " * 30_000, "en", "a", 150_000),
    (7, "É 漢字 ß 12 — !", "fr", "c", 14),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def clashing(odd):
    """Columns with the names that the operators use or add."""
    names = "row digest size shard slot copies rows n_hit kept_text component_id fp hash at w l nth gone_ id_ block p".split()
    return odd.select("*", *(F.lit("own").alias(n) for n in names))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))), None, f"s{i % 5}", None) for i in range(n)], vocabulary, rng


# --- 1


def brute_contamination(rows, items, n=10):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = split(text), set(), set()
        for item_id, item in items:
            v = split(item)
            k = min(n, len(v))
            wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(map(str, found - {None}))))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    rows, vocabulary, rng = corpus()
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([14, 10, 3, 1, 12, 25])] + [(90, None), (91, "..."), (92, "SHORT one")]
    rows += [(500 + i, f"{vocabulary[i]}, {items[j][1].upper()}! {vocabulary[i]} {items[j][1]}", None, None, None) for i, j in enumerate([0, 1, 2, 4, 5, 8])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontamination.BROADCAST_WINDOWS, 1):  # broadcast and shuffled join
        got = decontamination.contamination(docs_of(spark, rows + ODD), bench, broadcast_windows=bound).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got), key=str) == brute_contamination(rows + ODD, items)


def test_contamination_is_native(spark, odd):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    plan = decontamination.contamination(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_removals(spark, clashing, none):
    bench = spark.createDataFrame([(1, "One, two"), (2, None)], "item_id long, text string")
    kept = decontamination.remove_documents(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == len(ODD) - 3
    cut = {r.doc_id: (r.text, r.n_hit) for r in decontamination.remove_spans(docs_of(spark, [(1, "(One TWO, three)", None, None, None), (2, "x one", None, None, None)]), bench).collect()}
    assert cut == {1: ("(three)", 2), 2: ("x one", 0)}
    assert decontamination.remove_spans(clashing, bench).count() == len(ODD)
    assert decontamination.remove_documents(none, bench).count() == 0
    assert decontamination.remove_documents(clashing, bench.limit(0)).count() == len(ODD)


# --- 2


def test_language_on_held_out_texts(spark, none):
    rng = random.Random(3)
    stems = {"x": ["ka", "lo", "mi"], "y": ["sch", "ung", "ei"], "z": ["ção", "nh", "lh"]}
    text = lambda s: " ".join("".join(rng.choices(s, k=3)) for _ in range(20))
    rows = [(i, text(stems[k]), k, "s", 0) for i in range(100) for k in stems]
    model = language.fit(docs_of(spark, rows))
    assert model.labels == ("x", "y", "z")
    test = spark.createDataFrame([(text(s), k) for k, s in stems.items() for _ in range(20)], "text string, lang string")
    got = test.select("lang", language.identify(model, F.col("text")).alias("l")).select("lang", "l.*").collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 and r.accepted for r in got)
    odd = spark.createDataFrame([(None,), ("",), ("12 — !",), ("漢",)], "text string").select(language.identify(model, F.col("text")).alias("l")).select("l.*").collect()
    assert [r.lang_pred == "und" for r in odd] == [True, True, True, False] and not any(r.accepted for r in odd[:3])
    empty = language.fit(none)
    assert empty.labels == () and empty.predict("word") == ("und", 0.0)


def test_copies_neither_shrink_nor_fill_a_language(spark):
    rng = random.Random(5)
    text = lambda stems: " ".join("".join(rng.choices(stems, k=3)) for _ in range(12))
    stems = {"x": ["ka", "lo", "mi"], "y": ["sch", "ung", "ei"], "z": ["ção", "nh", "lh"]}
    rows = [(text(s), k) for k, s in stems.items() for _ in range(60)]
    hot = [spark.createDataFrame([(text(stems["x"]), "x")], "text string, lang string") for _ in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for h in hot:  # some of these hashes lie low, some high
        docs = docs.unionByName(h.join(spark.range(4000)).select("text", "lang"))
    docs = docs.unionByName(spark.createDataFrame([("12 —", "digits"), ("schnurz", "w")], docs.schema))
    got = language.labelled_sample(docs, rows=64).collect()
    by_lang = {k: {r.text for r in got if r.lang == k} for k in ("w", "x", "y", "z", "digits")}
    assert [len(by_lang[k]) for k in ("w", "x", "y", "z", "digits")] == [1, 16, 16, 16, 0]
    assert len(got) == 49  # no text twice
    model = language.fit(docs, rows=64)
    assert model.labels == ("w", "x", "y", "z")
    assert all(model.predict(t)[0] == k for t, k in rows)


def test_long_text_has_the_histogram_of_its_parts():
    text = "ab cé " * 400_000
    whole = language.histogram(text)
    size = language.CHUNK
    try:
        language.CHUNK = 1000
        assert np.array_equal(whole, language.histogram(text))
    finally:
        language.CHUNK = size


# --- 3


def test_url_verdicts(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no-scheme.net/x": ("", "", None, "allow"),
        "http://A.NET/x?q": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "http://a.net?x=/": ("a.net", "", None, "allow"),
        "https://b.example.net/en/1#t": ("b.example.net", "/en/1", "example.net/en/", "allow"), "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://xexample.com/de/": ("xexample.com", "/de/", None, "allow"), "http://x.example.com/de/": ("x.example.com", "/de/", "example.com/de/", "block"),
        "http://a.org/fr/casino": ("a.org", "/fr/casino", "org/fr/", "allow"), "http://a.com/casino": ("a.com", "/casino", None, "block"), "http://a.com/casinos": ("a.com", "/casinos", None, "allow"),
        "http://ads-track.example.com/x": ("ads-track.example.com", "/x", None, "block"), "http://ads.com/ads/ADS": ("ads.com", "/ads/ADS", None, "allow"),
        "http://\n": ("\n", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.allowed(pages).columns == pages.columns
    assert url_filter.allowed(pages).count() == sum(v[3] == "allow" for v in cases.values())
    assert url_filter.judge(pages.limit(0)).count() == 0


# --- 4


def reshared(sizes, weights):
    """Targets by handing the excess round until there is none."""
    want, excess, free = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while excess > 1e-9 and free:
        total = sum(weights[i] for i in free)
        for i in free:
            want[i] += excess * weights[i] / total
        excess = sum(max(0, w - 2 * s) for w, s in zip(want, sizes, strict=True))
        want = [min(w, 2 * s) for w, s in zip(want, sizes, strict=True)]
        free = {i for i in free if want[i] < 2 * sizes[i]}
    return want


def test_targets_equal_resharing(spark):
    rng = random.Random(5)
    for n in (1, 2, 4, 7, 9):
        sizes = [float(int(rng.choice([0, 1, 10, 100, 1000]) * rng.random())) for _ in range(n)]
        names = [f"s{i:02}" for i in range(n - 1)] + [None]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size double")).collect()}
        assert [got[s] for s in names] == pytest.approx(reshared(sizes, [(3, 1, 2)[i % 3] for i in range(n)]), rel=1e-6, abs=1e-6)


def test_flight_keeps_both_balances():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 300).astype(float), np.full(300, 0.37)
    out = mixing.flight(p, size, np.ones(300), np.random.default_rng(2))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out @ size == pytest.approx(p @ size) and out.sum() == pytest.approx(p.sum())
    landed = mixing.landing(p, out, size, np.ones(300))
    assert set(landed) <= {0.0, 1.0} and abs((landed - p) @ size) <= size.min() * 20


def test_mix_over_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 80), None, "hot" if i % 3 else f"s{i % 4}", None) for i in range(900)]
    plan = mixing.mix_plan(docs_of(spark, rows)).collect()
    again = mixing.mix_plan(docs_of(spark, rows[::-1]).repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in plan) == sorted((r.doc_id, r.copies) for r in again)
    assert len(plan) == 900 and all(0 <= r.copies <= 2 for r in plan)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert sum(r.size * r.copies for r in own) == pytest.approx(own[0].target, rel=0.02, abs=40)


def test_mix_odd_rows(odd, clashing, none):
    plan = mixing.mix_plan(odd).collect()
    assert sum(r.rows for r in plan) == len(ODD) and sum(r.rows for r in plan if r.doc_id == 5) == 2
    assert sum(r["size"] * r.rows for r in plan) == 30_000 + 2 * 4 + 6  # word counts
    mixed = mixing.mixed(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.count() == sum(r.rows * r.copies for r in plan)
    assert mixing.mix_plan(none).count() == 0 and mixing.mixed(none).count() == 0


# --- 5


def brute_lines(rows, min_docs):
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    split = [(i, (t or "").encode().split(b"\n")) for i, t, *_ in rows]
    held = {}
    for _, lines in split:
        for k in {key(x) for x in lines}:
            held[k] = held.get(k, 0) + 1
    gone = {k for k, n in held.items() if k and n >= min_docs}
    return sorted([(i, len(x), sum(key(y) in gone for y in x), hashlib.sha256(b"\n".join(y for y in x if key(y) not in gone)).hexdigest()) for i, x in split], key=str)


def lines_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect()), key=str)


def test_lines_equal_brute_force_and_are_reversible(spark):
    rng = random.Random(4)
    pool = [f"Line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice([" ", "\t", ""]) + rng.choice([str.upper, str])(rng.choice(pool)) for _ in range(rng.randint(0, 8))), None, None, None) for i in range(60)] + ODD
    first, second = docs_of(spark, rows[:40]), docs_of(spark, rows[40:])
    state = line_dedup.build(first, min_docs=5)
    assert lines_of(line_dedup.drop_lines(state, first)) == brute_lines(rows[:40], 5)
    both = line_dedup.insert(state, second)
    everything = first.unionByName(second)
    assert lines_of(line_dedup.drop_lines(both, everything)) == brute_lines(rows, 5)
    assert lines_of(line_dedup.drop_lines(both, everything, broadcast_bytes=0)) == brute_lines(rows, 5)  # routed to the shards
    back = line_dedup.delete(both, second)
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, state.refs.collect()))
    assert lines_of(line_dedup.drop_lines(back, first)) == brute_lines(rows[:40], 5)


def test_line_state_grows_from_empty(spark, none):
    """Inserts from an empty state equal one build, shards included; documents that never came cannot be deleted."""
    rows = [(i, "\n".join(f"Line {(i * 7 + k) % 90}" for k in range(6)), None, None, None) for i in range(120)]
    state = line_dedup.build(none, min_docs=5, shard_keys=1)
    for start in range(0, 120, 40):
        state = line_dedup.insert(state, docs_of(spark, rows[start : start + 40]))
    whole = docs_of(spark, rows)
    built = line_dedup.build(whole, min_docs=5, shard_keys=1)
    assert state.shards == built.shards > line_dedup.LEAST_SHARDS
    assert sorted(map(tuple, state.refs.collect())) == sorted(map(tuple, built.refs.collect()))
    assert lines_of(line_dedup.drop_lines(state, whole)) == brute_lines(rows, 5)
    assert lines_of(line_dedup.drop_lines(state, whole, broadcast_bytes=0)) == brute_lines(rows, 5)
    left = line_dedup.delete(state, docs_of(spark, rows[40:]))
    assert lines_of(line_dedup.drop_lines(left, docs_of(spark, rows[:40]))) == brute_lines(rows[:40], 5)
    with pytest.raises(ValueError, match="never counted"):
        line_dedup.delete(left, docs_of(spark, rows[40:80]))


def test_cuckoo():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    cuckoo = line_dedup.Cuckoo.sized(4000)
    assert cuckoo.insert(hi[:4000], lo[:4000]) and cuckoo.contains(hi[:4000], lo[:4000]).all() and cuckoo.contains(hi[4000:], lo[4000:]).sum() < 3
    cuckoo.delete(hi[:2000], lo[:2000])
    assert cuckoo.contains(hi[2000:4000], lo[2000:4000]).all() and cuckoo.contains(hi[:2000], lo[:2000]).sum() < 3
    assert not line_dedup.Cuckoo(np.zeros((2, 4), np.uint32)).insert(hi[:100], lo[:100])


def test_lines_odd(clashing, none):
    state = line_dedup.build(clashing, min_docs=2)
    got = line_dedup.drop_lines(state, clashing)
    assert got.columns == [c for c in clashing.columns if c != "kept_text"] + line_dedup.ADDED and got.count() == len(ODD)
    empty = line_dedup.build(none)
    assert line_dedup.drop_lines(empty, none).count() == 0
    assert line_dedup.insert(empty, clashing).refs.count() == state.refs.count()


# --- 6


def brute_simhash(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, near):
    low = {i: i for i in range(len(values))}
    for _ in values:
        for i, j in itertools.combinations(range(len(values)), 2):
            if near(values[i], values[j]):
                low[i] = low[j] = min(low[i], low[j])
    return low


@pytest.mark.parametrize("words", [3, 5])
def test_simhash_equals_brute_force(spark, words):
    rows, vocabulary, rng = corpus(60)
    base = " ".join(rng.choices(vocabulary, k=300)).split()
    for i in range(25):
        copy = list(base)
        copy[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(copy), None, None, None))
    rows = [r for r in rows + ODD if r[0] is not None and r[0] != 5 and r[0] > 7] + [(900, None, None, None, None), (901, " ", None, None, None)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, rows), words=words, tile_rows=4).collect()}
    rows.sort()
    prints = [brute_simhash(r[1], words) for r in rows]
    low = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert got == {r[0]: (f"{prints[i]:016x}", rows[low[i]][0]) for i, r in enumerate(rows)}


def test_one_of_each(odd, clashing, none):
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # 1, 2, 3 and the null row have no words; 4 and both 5 are equal
    assert ids == [1, 4, 6, 7, None]
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    assert simhash.near_duplicates(odd).count() == len(ODD)


def test_pipeline_near_dedup_equals_brute_force_jaccard(spark, monkeypatch, none, clashing):
    import corpus_pipeline
    from pairwright.llm import near_jaccard

    for name, value in {"CELL": 4, "BLOCK": 8, "PIVOTS": 2}.items():  # small cells, blocks and pivots all come into play
        monkeypatch.setattr(near_jaccard, name, value)
    rows, vocabulary, rng = corpus(60)
    for g in range(6):  # families around the limit: 0 to 12 of 150 words replaced
        base = rng.choices(vocabulary, k=150)
        for i in range(15):
            copy = list(base)
            for _ in range(rng.randrange(13)):
                copy[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append((1000 + 100 * g + i, " ".join(copy), None, None, None))
    line = " ".join(rng.choices(vocabulary, k=9))
    rows += [(2000 + i, line + " " + " ".join(rng.choices(vocabulary, k=5)), None, None, None) for i in range(30)]
    rows += [(3000, None, None, None, None), (3001, "", None, None, None), (3002, "A b", None, None, None), (3003, "a  B", None, None, None), (3003, "a  B", None, None, None)]

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(r[1]) for r in rows]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) > 0
    low = brute_components(sets, near)
    want = sorted({rows[r][0] for r in low.values()})
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(spark, rows), "").collect())
    assert got == want and len(want) < len({s for s in sets})
    by_bits = {r.doc_id for r in simhash.one_of_each(docs_of(spark, rows), words=5).collect()}
    assert len(by_bits) > len(want)
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0
    kept = corpus_pipeline.near_dedup(spark, clashing, "")
    assert kept.columns == clashing.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 6, 7, None]


def test_sketches_differ_in_no_more_bits_than_sets():
    from pairwright.llm import near_jaccard

    rng = np.random.default_rng(3)
    for n, common, m in [(1, 0, 1), (0, 0, 5), (200, 190, 205), (300, 290, 257), (900, 0, 1100), (5000, 4500, 4600)]:
        x = rng.integers(0, 2**63, n, np.uint64)
        y = np.concatenate([x[:common], rng.integers(0, 2**63, max(0, m - common), np.uint64)])
        apart = near_jaccard.sketches_apart(near_jaccard.parity_sketch(x), near_jaccard.parity_sketch(y))
        assert apart <= len(np.setxor1d(x, y))
        if n and not common and n > 100:
            assert apart * 9 > n + m  # sets that share nothing are told apart


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (7, 7), (100, 102)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "node long, root long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "node long, root long")).count() == 0


# --- 7


def test_licences(spark, odd, none):
    mit = license_scan.TEMPLATES["MIT"]
    gap = mit.replace("merge,", "merge and mend,").replace("publish,", "")
    texts = [mit, "before " * 50 + gap.upper() + " after" * 50, "Released under the MIT License. " * 3, "the license is free, under the sun", "Licensed under CC BY-NC 4.0.", mit[: len(mit) // 2], None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, round(r.coverage, 2)) for r in license_scan.scan_licenses(rows).collect()}
    assert got[0] == ("MIT", 1.0) and got[1][0] == "MIT" and 0.97 < got[1][1] < 1
    assert got[2] == ("MIT statement", 1.0) and got[4] == ("CC-BY-NC-4.0 statement", 1.0)
    assert [got[i] for i in (3, 5, 6, 7)] == [(None, 0.0)] * 4
    assert license_scan.scan_licenses(odd).count() == len(ODD) and license_scan.scan_licenses(none).count() == 0


def test_licences_need_their_name_and_version():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    best = lambda t: max(scanner.scan(t), key=lambda f: (f[1], len(license_scan.words(license_scan.TEMPLATES[f[0]]))), default=(None,))[0]
    work = "This work is licensed under the GNU "
    for text in (
        "Licensed under the Apache License.", "Licensed under the GPL License.", "Released under the same license.",
        work + "Lesser General Public License, version 2.1.", work + "General Public License, version 2.1.", work + "Affero General Public License, version 2.",
        license_scan.TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Affero General"), license_scan.TEMPLATES["GPL-3.0"].replace("version 3", "version 2"),
    ):
        assert best(text) is None, text
    assert best(work + "General Public License, version 2.0.") == "GPL-2.0 statement"
    for name, template in license_scan.TEMPLATES.items():
        assert best("before that " + template + " after it") == name
    bulleted = license_scan.TEMPLATES["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")
    assert best(bulleted) == "BSD-2-Clause" and best(license_scan.TEMPLATES["MIT"].replace("subject to", "1 subject by 2 to")) == "MIT"
    assert {"BSD-2-Clause", "BSD-3-Clause", "ISC whole text"} <= set(license_scan.TEMPLATES)


def test_alignment_is_a_common_subsequence_of_at_most_the_longest():
    rng = random.Random(8)
    for _ in range(60):
        a, b = (rng.choices("abcdefghijkl", k=rng.randint(0, 25)) for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert len(pairs) <= table[-1][-1]
    shuffled = rng.sample(range(40), 40)
    run = license_scan._increasing(list(enumerate(shuffled)))
    best = [1] * 40
    for i, j in itertools.combinations(range(40), 2):
        if shuffled[i] < shuffled[j]:
            best[j] = max(best[j], best[i] + 1)
    assert len(run) == max(best)


# --- 8


def test_maximal_segments_equal_brute_force():
    rng = random.Random(6)

    def brute(w, at=0):
        """The best segment, shortest among equals, then the same left and right of it."""
        best = max(((round(sum(w[i:j]), 9), i - j, -i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return brute(w[:i], at) + [(at + i, at + j, best[0])] + brute(w[j:], at + j)

    for _ in range(200):
        n = rng.randint(0, 18)
        scored = [(i, rng.choice([-2.5, -1.25, 1.125, 2.0625, 3.03125]) + i / 4096) for i in sorted(rng.sample(range(n), rng.randint(0, n)))]
        full = [-0.25] * n
        for i, s in scored:
            full[i] = s
        assert [(a, b, round(s, 9)) for a, b, s in toxicity.maximal_segments(scored, -0.25, n)] == brute(full)


def test_maximal_segments_of_a_long_text_take_linear_time():
    import time

    for gap, weight in ((1, 1.0), (5, 1.0), (2, 0.5), (3, 6.0)):  # between and above what the neutral words weigh
        started = time.perf_counter()
        found = toxicity.maximal_segments([(i * (gap + 1), weight) for i in range(1_000_000)], -0.25, 1_000_000 * (gap + 1))
        assert time.perf_counter() - started < 5 and found
    rng = random.Random(5)
    started = time.perf_counter()
    assert toxicity.maximal_segments([(i * 6, rng.choice([1.0, 0.4, -0.3, 2.0])) for i in range(1_000_000)], -0.25, 6_000_000)
    assert time.perf_counter() - started < 5


def test_toxicity(spark, none, odd):
    rows, vocabulary, rng = corpus(600)
    bad = ["vile", "scum", "moron"]
    toxic = {r[0] for r in rows if r[0] % 6 == 0}
    rows = [(i, f"{t} {' '.join(rng.choices(bad, k=4))} end" if i in toxic else t, *rest) for i, t, *rest in rows]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i, *_ in rows] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, rows), labels)
    got = docs_of(spark, rows).select("doc_id", toxicity.score_toxicity(model, F.col("text")).alias("t")).select("doc_id", "t.*").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) == int(r.doc_id in toxic) for r in got)
    assert all(len(r.passages) == 1 for r in got if r.doc_id in toxic)
    assert all(r.t.predicted == 0 for r in odd.select(toxicity.score_toxicity(model, F.col("text")).alias("t")).collect())
    flat = toxicity.fit(none, labels)
    assert 0 <= flat.probability(0, []) < 0.5 and flat.segments(["scum"]) == []


# --- 9


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(9)
    for _ in range(30):
        supply = [rng.randint(0, 50) for _ in range(rng.randint(1, 5))]
        room = resharding.capacities(sum(supply), rng.randint(1, 5))
        flow = resharding.min_cost_flow(supply, room, lambda i, j: float(i != j))
        assert [sum(f for i, _, f in flow if i == k) for k in range(len(supply))] == supply
        assert [sum(f for _, j, f in flow if j == k) for k in range(len(room))] == room
        stay = sum(min(s, r) for s, r in zip(supply, room, strict=False))  # what can stay does
        assert sum(f for i, j, f in flow if i == j) == stay


def test_flow_with_costs_equals_the_best_of_all():
    cost = [[4, 1, 3], [2, 5, 1], [3, 3, 2]]
    flow = resharding.min_cost_flow([1, 1, 1], [1, 1, 1], lambda i, j: cost[i][j])
    assert sum(cost[i][j] * f for i, j, f in flow) == min(sum(cost[i][p[i]] for i in range(3)) for p in itertools.permutations(range(3)))


def test_resharding(spark, odd, clashing, none, monkeypatch):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 8)
    rng = random.Random(10)
    rows = [(i, "same text" if i % 3 == 0 else "x" * rng.randint(0, 300), None, None, None) for i in range(2000)]
    docs = docs_of(spark, rows)
    got = resharding.per_row(resharding.plan(docs, 7)).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    total = sum(r["size"] for r in got)
    for shard in range(7):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) == pytest.approx(total / 7, abs=320)
    again = resharding.per_row(resharding.plan(docs.repartition(5), 7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    moved = sum(r["size"] for r in got if r.shard != r.old_shard)
    held = [sum(r["size"] for r in got if r.old_shard == s) for s in range(7)]
    assert moved == pytest.approx(sum(max(0, h - total / 7) for h in held), abs=320 * 7)

    odd_rows = resharding.resharded(clashing, 3)
    assert odd_rows.count() == len(ODD) and set(clashing.columns) <= set(odd_rows.columns)
    slots = sorted((r.shard, r.slot) for r in odd_rows.collect())
    assert slots == [(s, k) for s, g in itertools.groupby(slots, lambda x: x[0]) for k, _ in enumerate(g)]
    assert resharding.plan(none).count() == 0


def test_rewritten_files_hold_the_plan(spark, none, tmp_path, monkeypatch):
    """An old folder and a rewrite of the affected shards give the new plan, emptied shards and all."""
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 8)
    rng = random.Random(11)
    docs = docs_of(spark, [(i, "y" * rng.randint(0, 200), None, "s", None) for i in range(600)])
    path = f"{tmp_path}/shards"
    resharding.write_shards(resharding.resharded(docs, 6), path)
    old = resharding.read_shards(spark, path)
    sizes = {r.shard: r.total for r in old.groupBy("shard").agg(F.sum("size").alias("total")).collect()}
    assert len(sizes) == 6 and old.count() == 600
    # shards 4 and 5 are emptied into shards 0 and 1; 2 and 3 keep what they have
    capacity = [sizes[0] + sizes[4], sizes[1] + sizes[5], sizes[2], sizes[3], 0, 0]
    new = resharding.resharded(old, 6, old_shard=F.col("shard"), capacity=capacity)
    want = new.collect()
    changed = resharding.rewrite(new, path)
    got = resharding.read_shards(spark, path)
    found = got.collect()
    assert sorted((r.doc_id, r.text, r.shard) for r in found) == sorted((r.doc_id, r.text, r.shard) for r in want)
    # slots are the plan's in the shards written anew, those of before in the others, without gaps in all
    slots = {r.doc_id: r.slot for r in want if r.shard in changed} | {r.doc_id: r.slot for r in old.collect() if r.shard not in changed}
    assert all(r.slot == slots[r.doc_id] for r in found)
    places = sorted((r.shard, r.slot) for r in found)
    assert places == [(s, k) for s, g in itertools.groupby(places, lambda x: x[0]) for k, _ in enumerate(g)]
    assert {4, 5} <= set(changed) and {r.shard for r in got.select("shard").distinct().collect()} <= {0, 1, 2, 3}
    files = {f.split("version=")[1].split("/")[0] + "/" + f.split("shard=")[1].split("/")[0] for f in got.inputFiles()}
    assert files == {f"{int(s in changed)}/{s}" for s in range(4)}
    assert sorted((r.doc_id, r.shard) for r in resharding.read_shards(spark, path, 0).collect()) == sorted((r.doc_id, r.shard) for r in old.collect())
    nothing = f"{tmp_path}/nothing"
    resharding.write_shards(resharding.resharded(none, 3), nothing)
    assert resharding.read_shards(spark, nothing).count() == 0 and "slot" in resharding.read_shards(spark, nothing).columns


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(13)
    texts = ["same" * rng.randint(1, 60) + str(rng.randint(0, 300)) for _ in range(300)]
    rows = [(i, texts[i % 300], None, None, None) for i in range(1500)] + [(2000 + i, "crowd " * 40, None, None, None) for i in range(1500)]
    planned = resharding.plan(docs_of(spark, rows), 5).collect()
    sizes = [sum(r["size"] for r in planned if r.shard == s) for s in range(5)]
    share = sum(sizes) / 5
    assert all(abs(s - share) <= 2 * share / resharding.GROUP_SHARE + 1000 for s in sizes)
    shards = {}
    for r in planned:
        shards.setdefault(r.digest, set()).add(r.shard)
    crowd = next(r.digest for r in planned if r.doc_id == 2000)
    assert len(shards.pop(crowd)) > 1 and all(len(s) == 1 for s in shards.values())


# --- 10


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 24))
    near = [base[i % 8] + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.45]) for i in range(80)]
    rows = [*map(list, base), *map(list, near), list(base[0]), list(base[0] * 3), list(base[0][:12]), [0.0] * 24, None, [], [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [1.0] * 23]
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v], "own") for i, v in enumerate(rows)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class string").repartition(3)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    near_ = lambda i, j: good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.9
    low = brute_components(range(len(rows)), near_)
    want = {i: (sum(near_(i, j) for j in range(len(rows)) if j != i), low[i], low[i] == i) for i in range(len(rows))}
    for dims in (8, 16, 24):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(table, block_dims=dims, tile_rows=16).collect()}
        assert got == want
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_dedup.near_duplicates(odd).collect()), key=str) == [(3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True), (None, 2, 3, False)]
    assert vector_dedup.near_duplicates(odd.limit(0)).count() == 0
