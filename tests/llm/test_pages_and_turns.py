"""Phrase mining, main text and prefix trie: each against brute force or planted cases, and on odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairwright.llm import collocations, html_text, prefix_trie

DOC = "doc_id long, text string, lang string"

# --- 11


def pieces(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in ([x for x in re.split(r"[ \t]+", p) if x] for p in re.split(r"[.,;:!?\n-\r]", low)) if w]


def brute_phrases(rows, least, top):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for w in pieces(text):
            for k in (1, 2, 3):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        kept = []
        for p, a in n.items():
            if len(p) > 1 and a >= least and not any(len(q) > len(p) and b >= least and 2 * b >= a and any(q[i : i + len(p)] == p for i in range(2)) for q, b in n.items()):
                score, k = min((1_000_000 * a * a // (n[p[:k]] * n[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), n[p[:k]], n[p[k:]]))
        total = sum(c for p, c in n.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, le, r, total, -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(n=150, seed=4):
    rng = random.Random(seed)
    words = ["Sea", "sky", "é", "漢字", "x-1", "the", "of", "a", "to", "lamp"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None])) for i in range(n)]
    return [*rows, (n, None, "en"), (n + 1, "", None), (n + 2, ".,;:!?", "de"), (None, "of the lamp", None), *rows[:2]]


@pytest.mark.parametrize("least,top", [(10, 2000), (3, 15)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = texts()
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = collocations.top_phrases(docs, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)


def test_phrases_over_many_flushes_and_merges(spark, monkeypatch):
    rows = texts(60, 8)
    # no word is cut from its piece by the runs, no group by the parts in which it is merged
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 7)
    batch = spark.createDataFrame(rows, DOC).select("lang", "text").toArrow().to_batches()
    sent = list(collocations._packed(iter(batch)))
    import pyarrow as pa

    rows_in_order = pa.Table.from_batches(sent).sort_by([(c, "ascending") for c in ("lang", "first", "salt")]).to_batches(max_chunksize=3)
    for held in (1, 200, 1 << 20):
        monkeypatch.setattr(collocations, "HELD_BYTES", held)
        n = Counter()
        for b in collocations._merged(1)(iter(rows_in_order)):
            for r in b.to_pylist():
                n[r["lang"], *(r[c] for c in ("first", "second", "third") if r[c] is not None)] += r["n"]
        want = Counter()
        for _, text, lang in rows:
            for w in pieces(text):
                want.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        assert n == want


def test_passages_are_the_unary_paths(spark):
    passage = "one two three four five six seven"
    rows = [(i, f"{passage}. w{i} three four v{i}", "en") for i in range(12)] + [(20 + i, "loop loop loop loop", "en") for i in range(10)]
    counts = collocations.phrase_counts(spark.createDataFrame(rows, DOC), 10)
    paths = collocations.unary_paths(counts.where("second IS NOT NULL AND third IS NULL"), counts.where("third IS NOT NULL"))
    found = {(r.passage, r.words, r.n) for r in collocations.passages(paths).collect()}
    # "three four" occurs outside of the passage too, so the path stops there
    assert found == {("one two three four", 4, 12), ("three four five six seven", 5, 12), ("loop loop loop", 3, 20)}


def test_phrases_of_odd_tables(spark):
    assert collocations.top_phrases(spark.createDataFrame([], DOC)).count() == 0
    long = spark.createDataFrame([(1, "deep blue sea " * 30_000, None), (2, "word" * 200_000, "en")], DOC).withColumn("n", F.lit(1)).withColumn("first", F.lit("x")).withColumn("salt", F.lit(1))
    got = {r.phrase: r for r in collocations.top_phrases(long).collect()}
    assert set(got) == {"deep blue sea", "blue sea deep", "sea deep blue"} and got["deep blue sea"].a == 30_000 and got["deep blue sea"].n == 90_000


def test_score_is_exact(spark):
    a, le, r = 3_000_000_000, 4_000_000_001, 9_000_000_007
    assert spark.range(1).select(collocations.score(F.lit(a), F.lit(le), F.lit(r))).first()[0] == 1_000_000 * a * a // (le * r)


# --- 12

PROSE = "The people of the town have walked along the river for as long as they can remember, and it is not a long way to the sea."
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; T</title><style>p {{}}</style><script>var a = "<p>not this</p>";</script></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav>
<div class="cookie-notice"><p>{PROSE}</p></div><div id="left-sidebar">{PROSE}</div><!-- <p>hidden</p> -->
{{}}<div class="comments"><p>{PROSE}</p></div><form><input value="q">Search {PROSE}</form><aside>{PROSE}</aside>
<footer>&copy; {PROSE}</footer></body></html>"""


def test_article_is_kept_whole():
    article = f"<article><h1>A &lt;title&gt;</h1><p><b>First.<br><p>Two\n\n  spaces&nbsp;here</p><p>Short</p><div class=ad>{PROSE}</div><p>{PROSE}</p><nav>{PROSE}</nav><p>End&#33;</p><table><tr><td>a<td>b</table></article>"
    assert html_text.main_text(PAGE.replace("{}", article)) == f"A <title>\nFirst.\nTwo spaces here\nShort\n{PROSE}\nEnd!\na\nb"


def test_blocks_without_an_article_inherit_from_their_neighbours():
    page = PAGE.replace("{}", f"<div><h1>Title</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p><p>Last.</p></div>")
    assert html_text.main_text(page) == f"Title\n{PROSE}\nShort one.\n{PROSE}\nLast."
    links = "".join(f"<p><a href=/{i}>{PROSE}</a></p>" for i in range(3))
    assert html_text.main_text(f"<div>{links}</div><p>{PROSE}</p>") == PROSE
    assert html_text.first_pass(html_text.Block(PROSE, 0, False, 0)) is True
    assert html_text.first_pass(html_text.Block("Short.", 0, False, 0)) is None
    assert html_text.first_pass(html_text.Block(PROSE, 0, False, len(PROSE))) is False


def test_nearest_decided_block_counts():
    make = lambda text, bad=False: html_text.Block(text, 0, bad, 0)
    blocks = [make("menu", True), make("a"), make("b"), make("c"), make(PROSE)]
    assert html_text.second_pass(blocks, [html_text.first_pass(b) for b in blocks]) == [False, False, True, True, True]
    assert html_text.second_pass(blocks[1:4], [None] * 3) == [True] * 3


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<p", "<!--", "<script>x", "&", "</p></p>", "<article></article>", "<nav>x</nav>"])
def test_pages_without_text(page):
    assert html_text.main_text(page) in ("", page and page.strip())


def test_long_and_broken_pages_take_linear_time():
    for part in ("<a>", "<a><div>", "</div>", "<p><b>", '<p class="', "<!--", "<x ", "<i><div></b>", "&amp;"):
        started = time.perf_counter()
        html_text.main_text(part * 50_000 + "t")
        assert time.perf_counter() - started < 5, part


def test_pages_as_a_table(spark):
    rows = [(1, "u", PAGE.replace("{}", "<article>É</article>")), (1, "u", None), (None, None, "<p>x</p>"), (2, None, "<p>" + "word " * 200_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clashing = pages.withColumn("text", F.lit("own")).withColumn("n_chars", F.lit("own")).withColumn("block", F.lit(1))
    got = html_text.extract_pages(clashing)
    assert got.columns == ["page_id", "url", "block", "text", "n_chars"] and dict(got.dtypes)["n_chars"] == "bigint"
    assert sorted((r.page_id or 0, r.text[:4], r.n_chars) for r in got.collect()) == [(0, "x", 1), (1, "", 0), (1, "É", 1), (2, "word", 999_999)]
    assert html_text.extract_pages(pages.where("false")).count() == 0


# --- 13

TURN = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    for c in own:
        own[c] = [x[3:] for x in sorted(own[c])]
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids.update(p[:-1] for p in members if p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in kids
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items()), key=repr)


def nodes(df):
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=repr)


def conversations(seed, lengths, ids, texts=("a", "bé", None)):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["u", None]), rng.choice(texts)) for c in ids for t in range(rng.choice(lengths))]


@pytest.mark.parametrize("case", ["bushy", "copies", "long", "absent"])
def test_trie_equals_brute_force(spark, case):
    rows = {
        "bushy": conversations(1, [1, 2, 3, 5, 12], range(60)),
        "copies": conversations(2, [1, 4], range(20)) + [(100 + c, t, "u", "same") for c in range(40) for t in range(3)],
        # shared paths over more than a block of turns, private tails, sequences that end inside others
        "long": [(c, t, "u", "x" if t < 35 + c % 3 else f"{c % 4}") for c in range(0, 60, 5) for t in range(20 + 3 * c % 50)] + conversations(3, [70], [301]),
        "absent": conversations(4, [1, 9], [3, 4, 8, 13, 14, 19, 999]),
    }[case]
    assert nodes(spark.createDataFrame(rows, TURN).repartition(6)) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(5, None, None, None), (5, None, "u", "é"), (5, 1, "u", "x"), (5, 1, "u", "x"), (5, 1, "u", "y"), (None, 1, "u", "x"), (7, 3, None, "x" * 100_000), (10, 0, "", ""), (-3, 0, "u", "n")]
    rows += [(20, t, "u", "same") for t in range(300)]  # a conversation with most of the rows
    df = spark.createDataFrame(rows, TURN).repartition(3)
    clashing = df.select("*", *(F.lit("own").alias(n) for n in ("hash", "bytes", "depth", "key", "parent", "total", "seq", "path", "at", "own")))
    want = brute_trie([(c, t, r, x) for c, t, r, x in rows if c != -3])
    got = nodes(clashing.where("conv_id IS NULL OR conv_id <> -3"))
    assert got == want
    assert (-3, 0) in {(r[0], r[1]) for r in nodes(df)}  # the smallest id of all
    assert nodes(spark.createDataFrame([], TURN)) == []


def test_running_values_do_not_depend_on_the_partitions(spark):
    rows = [(c, t, "u", f"{t % 3}") for c in (1, 2) for t in range(400)]
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, TURN))
    seen = []
    for parts in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = prefix_trie.running(turns, ["turn", "hash"], "test")
            seen.append(sorted((r.conv_id, r.depth, bytes(r.key), bytes(r.parent), r.total) for r in got.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1] and [x[1] for x in seen[0]] == [*range(1, 401)] * 2
    by_place = {x[:2]: x for x in seen[0]}
    assert all(by_place[c, d][3] == (by_place[c, d - 1][2] if d > 1 else prefix_trie.ROOT) for c, d in by_place)
