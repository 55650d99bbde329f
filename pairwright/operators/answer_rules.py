"""Rule-driven answer checks: a list of (code, severity, predicate) evaluated per row.

A predicate maps the answer text to a boolean, or to a number when a rule can fire more
than once; a predicate on sentences gets the text's sentences, split once for all rules.
Everything is row-local, so a check is one scan without a shuffle.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pairwright import fixed_values as fixed
from pairwright.functions.text import WS, SPACE_CHARS, sentences, strip, substring_count

FAIL, WARN = "fail", "warn"


class Rule(NamedTuple):
    code: str
    severity: str
    fires: Callable[[Column], Column]
    on_sentences: bool = False  # ``fires`` takes the array of sentences in place of the text


def _has(text: Column, literal: str) -> Column:
    return F.contains(text, F.lit(literal))


def _has_all(text: Column, literals: list[str]) -> Column:
    found = F.lit(True)
    for literal in literals:
        found = found & _has(text, literal)
    return found


def _pattern(*alternatives: str, flags: str = "U") -> Column:
    """A pattern with Unicode whitespace, word and digit classes."""
    return F.lit(f"(?{flags})" + "|".join(alternatives).replace(r"\s", WS))


def wrong_direction(split: Column, patterns: list[str], literals: list[str]) -> Column:
    """Number of sentences that claim a wrong copy direction; memcpy-only sentences do not count.

    ``literals`` are parts that every match holds and that no folding of case changes: a
    sentence without them is not searched.
    """
    pattern = _pattern(*patterns, flags="iuU")

    def claims(s: Column) -> Column:
        return _has_all(s, literals) & ~(_has(s, "memcpy") & ~_has(s, "memmove")) & F.regexp_like(s, pattern)

    return F.size(F.filter(split, claims))


def _subject(sentence: Column) -> Column:
    """Function a sentence is about: one of the two names, '' if it names both, null if none."""
    lowered = F.lower(sentence)
    copy, move = _has(lowered, "memcpy"), _has(lowered, "memmove")
    return F.when(copy & move, "").when(copy, "memcpy").when(move, "memmove")


def _claims_temporary(lowered: Column) -> Column:
    return _has(lowered, "temporary") & (_has(lowered, "as if") | _has(lowered, "temporary array"))


def temporary_buffer_claim(split: Column) -> Column:
    """Does a sentence about memcpy alone give it the temporary-array guarantee?

    The subject is carried over to sentences that name neither function; the fold over
    the sentences of one text needs no shuffle.
    """

    def step(state: Column, sentence: Column) -> Column:
        own = _subject(sentence)
        subject = F.coalesce(own, state["subject"])
        about_copy = F.when(own.isNotNull(), own == "memcpy").otherwise(subject == "memcpy")
        return F.struct(
            subject.alias("subject"),
            (state["found"] | (about_copy & _claims_temporary(F.lower(sentence)))).alias("found"),
        )

    start = F.struct(F.lit("").alias("subject"), F.lit(False).alias("found"))
    return F.aggregate(split, start, step, lambda s: s["found"])


def carried_subjects(answers: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence with the carried-over subject (table form of the same rule).

    The sentences between two that name a function form a run of one subject, so a text is
    cut into runs and each sentence copied once.
    """
    split = answers.select(F.col(key).alias(key), sentences(F.col(text)).alias("split"))
    named = F.filter(
        F.transform("split", lambda s, i: F.struct(i.alias("start"), _subject(s).alias("subject"))),
        lambda m: m["subject"].isNotNull(),
    )
    split = split.withColumn("marks", F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("subject"))), named))
    ends = F.concat(F.transform(F.slice("marks", F.lit(2), F.size("marks")), lambda m: m["start"]), F.array(F.size("split")))
    runs = F.zip_with(
        "marks", ends,
        lambda m, end: F.struct(m["start"], m["subject"], F.slice("split", m["start"] + 1, end - m["start"]).alias("within")),
    )
    run = split.where(F.col("split").isNotNull()).select(key, F.explode(runs).alias("run"))
    placed = run.select(key, "run.start", "run.subject", F.posexplode("run.within").alias("place", "sentence"))
    return placed.select(key, (F.col("start") + F.col("place")).alias("pos"), "sentence", "subject")


def default_rules() -> list[Rule]:
    low = F.lower

    def ends_badly(t: Column) -> Column:
        trimmed = F.rtrim(t, F.lit(SPACE_CHARS))
        ends = F.lit(False)
        for mark in fixed.ANSWER_ENDINGS:
            ends = ends | F.endswith(trimmed, F.lit(mark))
        return ~ends

    def lacks_terms(t: Column) -> Column:
        lacking = F.lit(False)
        for term in fixed.REQUIRED_TERMS:
            lacking = lacking | ~_has(t, term)
        return lacking

    return [
        Rule("too_short", FAIL, lambda t: F.length(strip(t)) < fixed.MIN_ANSWER_CHARS),
        Rule("missing_required_term", FAIL, lacks_terms),
        Rule("unbalanced_code_fence", FAIL, lambda t: substring_count(t, "```") % 2 != 0),
        Rule("ends_mid_sentence", FAIL, ends_badly),
        Rule("literal_array_write", FAIL, lambda t: F.regexp_like(t, _pattern(fixed.LITERAL_ARRAY_WRITE, flags="sU"))),
        Rule("out_of_bounds_copy", FAIL, lambda t: F.regexp_like(t, _pattern(fixed.OUT_OF_BOUNDS_COPY))),
        Rule("runtime_called_ill_formed", FAIL, lambda t: _has(low(t), "ill-formed")),
        Rule("memcpy_temporary_guarantee", FAIL, temporary_buffer_claim, True),
        Rule("shift_output_inconsistent", FAIL, lambda t: _has_all(t, fixed.SHIFT_OUTPUT)),
        Rule(
            "shift_drops_suffix",
            FAIL,
            lambda t: _has_all(t, fixed.SHIFT_SUFFIX) & ~_has(t, fixed.SHIFT_SUFFIX_RIGHT),
        ),
        Rule(
            "backward_for_lower_dest",
            FAIL,
            lambda t: _has(t, fixed.LOWER_DEST_CALL) & (_has(low(t), "copies backward") | _has(low(t), "copying backward")),
        ),
        Rule("backward_when_dest_lower", FAIL, lambda s: wrong_direction(s, fixed.BACKWARD_WHEN_DEST_LOWER, ["<"]), True),
        Rule("forward_when_dest_higher", FAIL, lambda s: wrong_direction(s, fixed.FORWARD_WHEN_DEST_HIGHER, [">"]), True),
        Rule("no_limitation_note", FAIL, lambda t: ~_has(low(t), "limitation")),
        Rule(
            "no_undefined_behavior_note",
            WARN,
            lambda t: ~(_has(low(t), "undefined behavior") | _has(low(t), "behavior is undefined")),
        ),
        Rule(
            "no_assumption_note", WARN, lambda t: ~(_has(low(t), "assumption") | _has(low(t), "precondition"))
        ),
    ]


def _fires(rule: Rule, text: Column, split: Column) -> Column:
    return rule.fires(split if rule.on_sentences else text)


def _codes(text: Column, split: Column, rules: list[Rule], kinds: dict[str, str]) -> Column:
    found = []
    for rule in rules:
        fires = _fires(rule, text, split)
        times = fires if kinds[rule.code] == "int" else F.when(fires, 1).otherwise(0)
        found.append(F.array_repeat(F.lit(rule.code), times))
    return F.flatten(F.array(*found)) if found else F.expr("CAST(array() AS ARRAY<STRING>)")


def validate_answers(
    answers: DataFrame,
    rules: list[Rule] | None = None,
    kind: str | None = fixed.EXPECTED_ANSWER_KIND,
    model: str | None = fixed.EXPECTED_ANSWER_MODEL,
) -> DataFrame:
    """Add ``failures`` and ``warnings`` code arrays to each answer row."""
    rules = default_rules() if rules is None else rules
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.col("split_")
    held = answers.withColumn("split_", sentences(text))
    kinds = dict(held.select(*(_fires(r, text, split).alias(r.code) for r in rules)).dtypes)
    failures = _codes(text, split, [r for r in rules if r.severity == FAIL], kinds)
    for column, wanted in (("kind", kind), ("model", model)):
        if wanted is not None:
            wrong = F.lit(True) if column not in answers.columns else ~F.col(column).eqNullSafe(F.lit(wanted))
            failures = F.concat(F.array_repeat(F.lit(f"wrong_{column}"), F.when(wrong, 1).otherwise(0)), failures)
    warnings = _codes(text, split, [r for r in rules if r.severity == WARN], kinds)
    return held.withColumns({"failures": failures, "warnings": warnings}).drop("split_")


def answer_stats(answers: DataFrame, expected_count: int | None = None) -> DataFrame:
    """One row: row count against the expected one, id uniqueness, answer lengths (mean rounded down)."""
    size = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    ids = answers.groupBy(F.coalesce(F.col("prompt_id"), F.lit("")).alias("prompt_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.sum(size).alias("total")
    )
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return ids.agg(
        rows.alias("rows"),
        F.count(F.lit(1)).alias("unique_ids"),
        F.min("low").alias("min_chars"),
        F.floor(F.try_divide(F.sum("total"), F.sum("n"))).alias("avg_chars"),
        F.max("high").alias("max_chars"),
        ((rows == F.lit(expected_count)) if expected_count is not None else F.lit(True)).alias("count_ok"),
        (F.coalesce(F.max("n"), F.lit(1)) == 1).alias("ids_unique"),
    )
