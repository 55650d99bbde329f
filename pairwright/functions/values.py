"""Small value rules: yes flags, numbers, budgets, map merges, correlation, score formulas."""

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from pairwright import fixed_values as fixed
from pairwright.functions import text as T


def is_yes(value: Column) -> Column:
    return F.coalesce(F.lower(T.strip(value.cast("string"))).isin(fixed.YES_WORDS), F.lit(False))


def number_or_zero(df, name: str) -> Column:
    """Numbers count as themselves, everything else (text, null, absent) as 0."""
    if name not in df.columns:
        return F.lit(0.0)
    if dict(df.dtypes)[name].split("(")[0] in {"string", "binary", "date", "timestamp", "timestamp_ntz"}:
        return F.lit(0.0)
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def parsed_or_zero(df, name: str) -> Column:
    """Like :func:`number_or_zero`, but text that reads as a number counts as that number."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def compute_budget(parameters: Column) -> Column:
    """``k=v; k=v`` in key order, ``default`` for no parameters."""
    pairs = F.transform(
        F.array_sort(F.map_keys(parameters)),
        lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(parameters, k).cast("string"), F.lit("None"))),
    )
    return F.when(F.coalesce(F.size(parameters), F.lit(0)) > 0, F.array_join(pairs, "; ")).otherwise("default")


def merge_maps(*maps: Column) -> Column:
    """Union of maps, the later one winning on a shared key."""
    merged = maps[0]
    for later in maps[1:]:
        merged = _put_all(merged, later)
    return merged


def _put_all(first: Column, later: Column) -> Column:
    kept = F.map_filter(first, lambda key, value: ~F.map_contains_key(later, key))
    return F.map_concat(kept, later)


def put(metadata: Column, **entries: Column) -> Column:
    """Set keys of a metadata map."""
    pairs = [part for key, value in entries.items() for part in (F.lit(key), value.cast("string"))]
    return merge_maps(metadata, F.create_map(*pairs))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, 0 for fewer than two rows or no variance."""
    return F.coalesce(
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)
    )


def rule_reward(answer: Column, rewards: list[str] = (), penalties: list[str] = ()) -> Column:
    """+1 per reward word contained, -1 per penalty word contained, plus a capped length bonus."""
    lowered = F.lower(answer)

    def hits(words: list[str]) -> Column:
        return sum((F.contains(lowered, F.lit(w.lower())).cast("double") for w in words), F.lit(0.0))

    bonus = F.least(T.token_count(answer) / F.lit(100.0), F.lit(0.25))
    return hits(rewards) - hits(penalties) + bonus


def style_noise(metrics: Mapping[str, Column] | Column) -> Column:
    return metrics["abnormal_symbol_count"] + metrics["code_fence_mismatch"] + metrics["slogan_phrase_count"]


def criterion_score(
    score: Column, repeats: Column, words: Column, noise: Column,
    repeat_weight: Column, length_weight: Column, noise_weight: Column,
) -> Column:
    return score - repeat_weight * repeats - length_weight * words / F.lit(100.0) - noise_weight * noise
