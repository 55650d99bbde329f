"""URL filter: host and path rules before a weighted vocabulary.

An Aho-Corasick automaton finds every vocabulary term of a url in one pass; a term counts
only between boundaries (no ASCII letter or digit beside it).  One strict term, or soft
terms of enough distinct weight, reject the url.
"""

from collections.abc import Iterable
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

STRICT = ("porn", "xxx", "hardcore", "escort", "warez", "malware", "phishing", "casino")
SOFT = {"ads": 1, "ad": 1, "track": 1, "tracker": 1, "banner": 1, "popup": 1, "click": 1, "sponsor": 1, "affiliate": 1, "sex": 1, "adult": 1, "bet": 1, "poker": 1, "spam": 1, "torrent": 1, "crack": 1}
SOFT_WEIGHT = 2  # distinct soft weight that rejects
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@cache
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    if terms:
        found.make_automaton()
    return found


def _ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def terms_of(url: str | None, terms: tuple[str, ...]) -> set[str]:
    """The distinct terms of the whole url that stand between boundaries."""
    if not url or not terms:
        return set()
    low = _ascii_lower(url)
    edge = lambda i: not (0 <= i < len(low) and low[i].isascii() and low[i].isalnum())
    return {t for end, t in _automaton(terms).iter(low) if edge(end + 1) and edge(end - len(t))}


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; a rule fits its host and every subdomain."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, strict: tuple[str, ...] = STRICT,
    soft: dict[str, int] = SOFT, soft_weight: int = SOFT_WEIGHT, url: str = "url",
) -> DataFrame:
    """Add host, path, rule, verdict, strict_hits, soft_hits; input columns of these names are replaced.

    The rules (a list the caller states, part of the plan) decide first, the vocabulary
    decides the rest.  A null or empty url has an empty host and path, meets no rule and no
    term, and is allowed.
    """
    terms = (*strict, *soft)
    strict_set = frozenset(strict)

    @F.pandas_udf("strict_hits array<string>, soft_hits array<string>")
    def hits(urls: pd.Series) -> pd.DataFrame:
        found = [terms_of(u, terms) for u in urls]
        return pd.DataFrame({"strict_hits": [sorted(f & strict_set) for f in found], "soft_hits": [sorted(f - strict_set) for f in found]})

    added = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits"]
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in added]
    host, path = split_url(F.col(url))
    weight = F.aggregate(F.transform("h.soft_hits", lambda t: F.create_map(*(F.lit(x) for kv in soft.items() for x in kv))[t] if soft else F.lit(0)), F.lit(0), lambda a, b: a + b)
    rejected = (F.size("h.strict_hits") > 0) | (weight >= soft_weight)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    read = pages.select(*kept, host.alias("host"), path.alias("path"), hits(url).alias("h"))
    return read.withColumn("r", rule).select(
        *kept, "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(rejected, "block").otherwise("allow")).alias("verdict"), "h.strict_hits", "h.soft_hits",
    )


def allowed(pages: DataFrame, **options) -> DataFrame:
    """The pages whose verdict is allow, with their own columns."""
    judged = judge(pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page"), F.col(options.get("url", "url")).alias("url")), **{**options, "url": "url"})
    return judged.where("verdict = 'allow'").select("page.*")
