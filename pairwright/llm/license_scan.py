"""License scan by patience alignment.

Words that occur once in the text and once in the template anchor the alignment; the longest
increasing subsequence of the anchors is kept, and the gaps between them are aligned in the
same way.  Coverage is the share of the template's words that are aligned; in a short
statement inserted words count too.  Words of a licence's name and version must be aligned,
and no other licence's may be inserted.
"""

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairwright.llm.license_texts import MARKS, TEMPLATES, TEXT_MARKS

COVERAGE = 0.8
SLACK = 1.25  # how much longer than the template its occurrence may be
SHORT = 20  # words of a statement; inserted words count against its coverage
WORD = re.compile(rb"[0-9]+(?:\.[0-9]+)+(?![0-9a-z\x80-\xff])|[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text; a version such as 2.1 is one word, 2.0 is 2."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    return [w[:-2] if w.endswith(b".0") else w for w in found]


NAMING, TEXT_NAMING = frozenset(words(MARKS)), frozenset(words(TEXT_MARKS))


def marks(template: list[bytes]) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """(words that must be aligned, words that must not be inserted)."""
    if len(template) <= SHORT:
        own = NAMING.intersection(template)
        return own, NAMING - own - {b"by"}
    own = TEXT_NAMING.intersection(template)
    return own | {w for v, w in zip(template, template[1:], strict=False) if v in (b"version", b"v") and w in NAMING}, TEXT_NAMING - own


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, that increases in the second: patience piles."""
    tops, piles, back = [], [], []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[pile], piles[pile] = y, i
    run, i = [], piles[-1] if piles else -1
    while i >= 0:
        run.append(pairs[i])
        i = back[i]
    return run[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """(text position, template position) of the aligned words, increasing in both."""
    found, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # equal ends need no anchor
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        once = {w for w, n in Counter(text[a:b]).items() if n == 1} & {w for w, n in Counter(template[c:d]).items() if n == 1}
        if not once:
            continue
        at = {w: i for i, w in enumerate(text[a:b], a) if w in once}
        anchors = _increasing([(i, at[w]) for i, w in enumerate(template[c:d], c) if w in once])
        found.extend((y, x) for x, y in anchors)
        edges = [(c - 1, a - 1), *anchors, (d, b)]
        todo.extend((y0 + 1, y1, x0 + 1, x1) for (x0, y0), (x1, y1) in zip(edges, edges[1:], strict=False))
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words(t)) for name, t in sorted(templates.items()) if words(t)]
        self.counts = [Counter(t) for _, t in self.templates]
        self.known = set().union(*self.counts) if self.counts else set()

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, word after the last) of every template covered enough."""
        all_words = words(text)
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(all_words):
            if w in self.known:
                places.setdefault(w, []).append(i)
        found = []
        for (name, template), counts in zip(self.templates, self.counts, strict=True):
            # an alignment can't hold more of a word than both have: leaves nothing out
            if sum(min(n, len(places.get(w, ()))) for w, n in counts.items()) < self.coverage * len(template):
                continue
            best = max((self._at(all_words, template, start) for start in self._starts(template, places)), default=None)
            if best and best[0] >= self.coverage:
                found.append((name, best[0], -best[1], best[2]))
        return found

    def _starts(self, template: list[bytes], places: dict[bytes, list[int]]) -> list[int]:
        """Where an occurrence may start: of any set of more words than it may lack, it holds one."""
        lack = int((1 - self.coverage) * len(template) + 1e-9) + 1
        rare = sorted(range(len(template)), key=lambda i: (len(places.get(template[i], ())), i))[:lack]
        return sorted({int(p - SLACK * i - 3) for i in rare for p in places.get(template[i], ())})

    def _at(self, all_words: list[bytes], template: list[bytes], start: int) -> tuple[float, int, int]:
        start = max(0, start)
        part = all_words[start : start + int(2 * SLACK * len(template)) + 8]
        pairs = align(part, template)
        if not pairs:
            return 0.0, 0, 0
        at = np.array([p for p, _ in pairs])
        # the densest stretch of the length an occurrence may have
        ends = np.searchsorted(at, at + int(SLACK * len(template)) + 3)
        i = int((ends - np.arange(len(at))).argmax())
        first, end = int(at[i]), int(at[ends[i] - 1]) + 1
        inserted = set(range(first, end)) - {p for p, _ in pairs[i : ends[i]]}
        own, foreign = marks(template)
        if own - {template[q] for _, q in pairs[i : ends[i]]} or any(part[p] in foreign for p in inserted):
            return 0.0, 0, 0
        size = len(template) + (len(inserted) if len(template) <= SHORT else 0)
        return float(ends[i] - i) / size, -(start + first), start + end


def licenses(text: Column, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> Column:
    """array of struct(name, coverage, first_word, end_word) per whole text, best covered first, then the longer template.

    A null, empty or wordless text has none.
    """
    length = {name: len(words(t)) for name, t in templates.items()}

    @F.pandas_udf("array<struct<name:string,coverage:double,first_word:long,end_word:long>>")
    def scan(texts: pd.Series) -> pd.Series:
        scanner = Scanner(templates, coverage)
        found = [sorted(scanner.scan(t), key=lambda f: (-f[1], -length[f[0]], f[0])) for t in texts]
        return pd.Series([[dict(zip(("name", "coverage", "first_word", "end_word"), f, strict=True)) for f in fs] for fs in found])

    return scan(text)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id``, ``license`` (best template, null if none), ``coverage`` (0 if none), ``licenses`` (all found) per document row."""
    found = docs.select("doc_id", licenses(F.col("text"), templates, coverage).alias("licenses"))
    best = F.try_element_at("licenses", F.lit(1))
    return found.select("doc_id", best["name"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), "licenses")
