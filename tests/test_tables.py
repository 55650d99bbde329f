import pytest

from pairwright.operators import compare, completeness, criteria, guardrail, scoring, tables
from pairwright.sources.prompts import generate_prompts, guardrail_prompts
from tests.conftest import rows


def test_overall_errors_latency(spark):
    df = spark.createDataFrame(
        [
            ("p1", "raw", ">>> buy now ===>", 0, 10.0),
            ("p1", "ttc_beam", "The limits come first, then the steps.", 2, 25.0),
            ("p2", "raw", "```c\nlong one(void) {return 1;}\n", 0, None),
        ],
        "prompt_id STRING, method STRING, final_answer STRING, verifier_call_count INT, latency_ms DOUBLE",
    )
    overall = rows(tables.overall_table(df), "method")
    assert [r["method"] for r in overall] == ["raw", "ttc_beam"]
    assert overall[0]["count"] == 2
    assert overall[0]["abnormal_symbol_count_mean"] == 1.5
    errors = rows(tables.error_breakdown(df), "method")
    assert errors[0]["code_fence_mismatch_total"] == 1
    latency = rows(tables.latency_table(df), "method")
    assert latency[0]["latency_ms_mean"] == 5.0
    assert latency[1]["verifier_call_count_mean"] == 2.0


def test_numeric_text_counts_as_zero_only_in_the_latency_table(spark):
    df = spark.createDataFrame([("m", "30", "x")], "method STRING, latency_ms STRING, final_score STRING")
    assert tables.latency_table(df).first().latency_ms_mean == 0.0
    row = tables.quality_vs_compute(df).first()
    assert (row.latency_ms_mean, row.final_score_mean, row.compute_budget) == (30.0, 0.0, "default")


def test_quality_by_budget(spark):
    df = spark.createDataFrame(
        [
            ("ttc_beam", {"beam_width": "2", "beta": "1.5"}, 1.0, 1, 30.0),
            ("ttc_beam", {"beta": "1.5", "beam_width": "2"}, 2.0, 3, 36.0),
        ],
        "method STRING, decoding_parameters MAP<STRING,STRING>, final_score DOUBLE, verifier_call_count INT, latency_ms DOUBLE",
    )
    (row,) = rows(tables.quality_vs_compute(df))
    assert row == {
        "method": "ttc_beam", "compute_budget": "beam_width=2; beta=1.5", "count": 2,
        "final_score_mean": 1.5, "verifier_call_count_mean": 2.0, "latency_ms_mean": 33.0,
    }


def test_metric_summaries(spark):
    df = spark.createDataFrame(
        [("raw", {"a": 2.0, "w": 10.0}), ("raw", {"a": 4.0, "w": 14.0}), ("ttc", {"a": 0.0})],
        "method STRING, metrics MAP<STRING,DOUBLE>",
    )
    got = {(r["method"], r["name"]): r["value"] for r in rows(tables.summarize_metric_map(df))}
    assert got == {
        ("raw", "count"): 2.0, ("raw", "a"): 3.0, ("raw", "w"): 12.0, ("ttc", "count"): 1.0, ("ttc", "a"): 0.0,
    }


def test_review_sheet(spark):
    df = spark.createDataFrame(
        [("p1", "raw", "Q1", "old", 0), ("p1", "raw", "Q1b", "A raw", 1), ("p1", "ttc_beam", "Q1", "A beam", 2), ("p2", "raw", "Q2", "B raw", 3)],
        "prompt_id STRING, method STRING, prompt STRING, final_answer STRING, seq INT",
    )
    sheet = rows(tables.human_review_sheet(df, ["raw", "ttc_beam"]), "prompt_id")
    assert len(sheet) == 2
    assert (sheet[0]["prompt"], sheet[0]["raw_answer"], sheet[0]["ttc_beam_answer"]) == ("Q1", "A raw", "A beam")
    assert sheet[0]["best_method"] == "" and sheet[1]["ttc_beam_answer"] is None


def test_human_preference_table(spark):
    votes = [
        ("1", "ttc_beam", "yes", "no", "no"),
        ("2", "ttc_beam", "yes", "no", "no"),
        ("3", "raw", "no", "no", "no"),
        ("4", " ttc_beam ", "yes", "yes", "no"),
        ("5", "ttc_mcts", "yes", "no", "yes"),
        ("6", " ", "yes", "yes", "yes"),
    ]
    df = spark.createDataFrame(votes, "prompt_id STRING, best_method STRING, " + ", ".join(f"{f} STRING" for f in tables.HUMAN_FLAGS))
    got = rows(tables.human_preference_table(df), "method")
    assert [(r["method"], r["best_count"], r["preference_rate"]) for r in got] == [
        ("raw", 1, 0.2), ("ttc_beam", 3, 0.6), ("ttc_mcts", 1, 0.2),
    ]
    assert {r["ttc_removes_visible_defects_yes_rate"] for r in got} == {0.8}
    assert {r["verifier_over_penalizes_valid_wording_yes_count"] for r in got} == {1}


def test_guardrail(spark):
    outputs = spark.createDataFrame(
        [
            ("guardrail-0001", "ttc_beam", "Shared ranges overlap, so memmove. Before memcpy name your assumptions."),
            ("guardrail-0002", "raw", "Such a lock is always safe, a deadlock cannot happen."),
        ],
        "prompt_id STRING, method STRING, final_answer STRING",
    )
    prompts = spark.createDataFrame(
        [
            ("guardrail-0001", "string.h", ["memmove", "overlap"], ["always safe"]),
            ("guardrail-0002", "pthread", ["deadlock", "mutex"], ["always safe", "cannot happen"]),
        ],
        "prompt_id STRING, topic STRING, expected_keywords ARRAY<STRING>, unsafe_claims ARRAY<STRING>",
    )
    details = guardrail.guardrail_details(outputs, prompts)
    first, second = rows(details, "prompt_id")
    assert first["passed"] and first["missing_keywords"] == "" and first["unsafe_claims"] == ""
    assert second["missing_keywords"] == "mutex"
    assert second["unsafe_claims"] == "always safe, cannot happen"
    overall = [r for r in rows(guardrail.guardrail_summary(details)) if r["scope"] == "all"][0]
    assert (overall["count"], overall["passed_count"], overall["pass_rate"], overall["unsafe_claim_count"]) == (2, 1, 0.5, 1)
    empty = rows(guardrail.guardrail_summary(details.limit(0)))
    assert [(r["scope"], r["count"], r["pass_rate"]) for r in empty] == [("all", 0, 0.0)]
    with pytest.raises(Exception, match="no guardrail prompt"):
        guardrail.guardrail_details(outputs, prompts.limit(1)).collect()


def test_generated_prompts(spark):
    few = rows(generate_prompts(spark, 6), "prompt_id")
    assert few[0]["prompt_id"] == "taxonomy-000001"
    assert few[0]["prompt"] == (
        "Explain memcpy versus memmove in C or systems programming. State assumptions, boundary conditions, "
        "and one concise example. Frame the answer for a junior systems-programming student. "
        "Use Markdown headings and avoid unsupported claims."
    )
    assert few[0]["metadata"]["topic"] == "string.h"
    assert few[1]["metadata"]["task_type"] == "debugging"
    assert generate_prompts(spark, 200).select("prompt").distinct().count() == 200
    assert generate_prompts(spark, 10_000).count() == 6912
    assert generate_prompts(spark, 10_000).select("prompt").distinct().count() == 6912
    with pytest.raises(ValueError):
        generate_prompts(spark, 0)


def test_guardrail_prompts(spark):
    prompts = rows(guardrail_prompts(spark, 30), "prompt_id")
    assert len(prompts) == 30 and prompts[0]["prompt_id"] == "guardrail-0001"
    assert prompts[0]["prompt"] == prompts[10]["prompt"]
    assert all(p["expected_keywords"] for p in prompts)


PAIRS = [
    ("p1", "Plain reply, limits named.", ">>> loud reply", 3.0, -1.0),
    ("p2", "Ordered reply that covers both ends.", "Poor reply ===>", 2.5, 0.0),
    ("p3", "Right and short.", "Wrong reply.", 0.5, 1.0),
]


def test_score_validation(spark):
    df = spark.createDataFrame(PAIRS, "prompt_id STRING, chosen STRING, rejected STRING, chosen_score DOUBLE, rejected_score DOUBLE")
    report, failures = scoring.validate_scores(df, 0.65)
    row = report.first()
    assert row["count"] == 3 and abs(row.pairwise_accuracy - 2 / 3) < 1e-12 and row.passed_min_accuracy
    assert (row.mean_margin, row.median_margin, row.min_margin, row.max_margin) == (2.0, 2.5, -0.5, 4.0)
    assert row.markdown_score_correlation == 0.0
    assert [r["prompt_id"] for r in rows(failures)] == ["p3"]
    empty = scoring.validate_scores(df.limit(0))[0].first()
    assert (empty["count"], empty.pairwise_accuracy, empty.passed_min_accuracy, empty.median_margin, empty.min_margin) == (0, 0.0, False, 0.0, None)


def test_pairwise_and_regressions(spark):
    scores = spark.createDataFrame(
        [("p1", "a", 1.0, 0), ("p1", "b", 2.0, 1), ("p2", "a", 5.0, 2), ("p2", "b", 1.0, 3), ("p3", "a", 1.0, 4),
         ("p4", "a", 9.0, 5), ("p4", "b", 3.0, 6), ("p4", "a", 3.0, 7), ("p5", "a", 0.0, 8), ("p5", "b", 4.0, 9)],
        "prompt_id STRING, method STRING, score DOUBLE, seq INT",
    )
    (row,) = rows(compare.pairwise(scores, "a", ["b"], sample=1))
    assert (row["wins"], row["losses"], row["ties"], row["compared"]) == (1, 2, 1, 4)
    assert row["win_rate"] == 0.25 and row["loss_ids"] == ["p1"]
    (none,) = rows(compare.pairwise(scores, "a", ["absent"]))
    assert (none["compared"], none["win_rate"], none["loss_ids"]) == (0, 0.0, [])
    outputs = spark.createDataFrame([("p5", "a", "q", "mine", 0), ("p5", "b", "q", "other", 1)], "prompt_id STRING, method STRING, prompt STRING, final_answer STRING, seq INT")
    worst = rows(compare.regressions(scores, outputs, "a", "b", n=2))
    assert [(r["prompt_id"], r["margin"]) for r in worst] == [("p5", -4.0), ("p1", -1.0)]
    assert worst[0]["candidate_answer"] == "mine" and worst[1]["base_answer"] == ""
    assert worst[0]["scores"] == {"a": 0.0, "b": 4.0}


def test_completeness(spark):
    expected = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "prompt_id STRING")
    a = spark.createDataFrame([("p1", "x", 0), ("p2", "y", 1), ("p3", "z", 2)], "prompt_id STRING, text STRING, seq INT")
    b = spark.createDataFrame([("p1", "x", 0), ("p1", "newer", 1), ("p9", " ", 2)], "prompt_id STRING, answer STRING, seq INT")
    outputs = {"a": (a, "text"), "b": (b, "answer")}
    report = completeness.completeness_report(expected, outputs)
    good, bad = rows(report, "method")
    assert good["ok"] and good["rows"] == 3
    assert not bad["ok"]
    assert (bad["missing"], bad["extra"], bad["duplicates"], bad["empty"]) == (["p2", "p3"], ["p9"], ["p1"], ["p9"])
    assert rows(completeness.overall_completeness(report)) == [{"merged_rows": 4, "ok": False}]
    merged = rows(completeness.merge_outputs(expected, outputs), "method", "prompt_id")
    assert [(r["method"], r["prompt_id"], r["final_answer"]) for r in merged] == [
        ("a", "p1", "x"), ("a", "p2", "y"), ("a", "p3", "z"), ("b", "p1", "newer"),
    ]


def plain_grid(pairs, grid):
    import re
    import statistics

    def features(text):
        lines = [x.strip().lower() for x in text.splitlines() if x.strip()]
        noise = sum(len(re.findall(p, text)) for p in (">>>+", "===>+", "-{2,}>", "<-{2,}", "={3,}"))
        noise += text.count("```") % 2 + text.lower().count("slogan")
        return len(lines) - len(set(lines)), len(re.findall("[A-Za-z0-9_]+", text)), noise

    found = []
    for repeat, length, abnormal in grid:
        margins = []
        for _, chosen, rejected, cs, rs in pairs:
            (cr, cw, cn), (rr, rw, rn) = features(chosen), features(rejected)
            margins.append((cs - repeat * cr - length * cw / 100 - abnormal * cn) - (rs - repeat * rr - length * rw / 100 - abnormal * rn))
        found.append((sum(m > 0 for m in margins) / len(margins), statistics.mean(margins), statistics.median(margins), min(margins)))
    return found


def test_criteria_search(spark):
    df = spark.createDataFrame(PAIRS, "prompt_id STRING, chosen_text STRING, rejected_text STRING, chosen_score DOUBLE, rejected_score DOUBLE")
    grid = criteria.weight_grid()
    assert len(grid) == 120
    found = criteria.search_criteria(df).persist()
    got = rows(found.orderBy("grid_order"))
    for row, want in zip(sorted(got, key=lambda r: r["grid_order"]), plain_grid(PAIRS, grid)):
        assert abs(row["mean_margin"] - want[1]) < 1e-12 and abs(row["median_margin"] - want[2]) < 1e-12
        assert row["pairwise_accuracy"] == want[0] and abs(row["min_margin"] - want[3]) < 1e-12
    best = criteria.choose_criterion(found).first()
    assert (best.repeated_penalty, best.abnormal_penalty) == (0.0, 2.0)
    ranked = [r["grid_order"] for r in criteria.ranked_criteria(found, 10).collect()]
    assert ranked[0] == best.grid_order and len(ranked) == 10


def test_scoring_methods_needs_every_score(spark):
    outputs = spark.createDataFrame([("p1", "a", "x"), ("p2", "a", "y")], "prompt_id STRING, method STRING, final_answer STRING")
    scores = spark.createDataFrame([("p1", "a", 1.0, 0)], "prompt_id STRING, method STRING, score DOUBLE, seq INT")
    weights = spark.createDataFrame([(0.0, 0.0, 0.0)], "repeated_penalty DOUBLE, length_penalty_per_100_words DOUBLE, abnormal_penalty DOUBLE")
    with pytest.raises(Exception, match="output without a score"):
        criteria.score_methods(outputs, scores, weights).collect()
    (row,) = rows(criteria.score_methods(outputs.limit(1), scores, weights))
    assert row["criterion_score_median"] == 1.0


def test_join_metric_tables(spark):
    a = spark.createDataFrame([("raw", 1, 2.0)], "method STRING, count INT, x DOUBLE")
    b = spark.createDataFrame([("raw", 5, 3.0), ("beam", 7, 4.0)], "method STRING, count INT, y DOUBLE")
    got = rows(tables.join_metric_tables(a, b), "method")
    assert got == [
        {"method": "beam", "count": 7, "x": None, "y": 4.0},
        {"method": "raw", "count": 5, "x": 2.0, "y": 3.0},
    ]
