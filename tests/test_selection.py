import math
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import selection
from pairwright.operators.scoring import client_scorer, rule_scorer
from tests.conftest import rows

SCRIPT = "prefix STRING, ord INT, text STRING, logprob DOUBLE, is_complete BOOLEAN"


def prompts(spark, n=1):
    return spark.createDataFrame([(f"p{i}", f"Question {i}?") for i in range(n)], "prompt_id STRING, prompt STRING")


def test_beam_prunes_the_noisy_branch(spark):
    script = spark.createDataFrame(
        [("", 0, " >>> copying never hurts.", -0.1, True), ("", 1, " Where both ranges overlap, memmove copes.", -0.4, True)],
        SCRIPT,
    )
    scorer = rule_scorer(["overlap", "memmove"], [">>>", "never hurts"])
    expander = selection.scripted_expander(script)
    (row,) = rows(selection.beam(prompts(spark), expander, scorer, beam_width=1, expansions=2, beta=2.0, max_steps=1))
    assert row["final_answer"] == "Where both ranges overlap, memmove copes."
    assert row["verifier_call_count"] == 2 and len(row["steps"][0]["pruned"]) == 1
    candidates = script.select(F.lit("p0").alias("prompt_id"), "ord", "text", "logprob", "is_complete")
    (same,) = rows(selection.rerank(candidates, scorer, beam_width=1, expansions=2, beta=2.0))
    assert (same["final_answer"], same["final_score"], same["verifier_call_count"]) == (row["final_answer"], row["final_score"], 2)


def test_published_scores(spark):
    """Final scores of the two scripted records: 7.96 for reranking, 1.81 for the lookahead."""
    # fixed values: the rows behind the published scores
    script = spark.createDataFrame(
        [("", 0, " State assumptions first, explain the boundary conditions, and give a concise technical example.", -0.3, True),
         ("", 1, " >>> This is a revolutionary answer ===> trust it.", -0.1, True)],
        SCRIPT,
    )
    scorer = rule_scorer(["assumptions", "boundary", "concise", "technical"], [">>>", "===>", "revolutionary", "trust it"])
    (row,) = rows(selection.beam(prompts(spark), selection.scripted_expander(script), scorer, beam_width=1, expansions=2, beta=2.0, max_steps=1))
    assert abs(row["final_score"] - 7.96) < 1e-9
    assert abs(row["steps"][0]["pruned"][0]["total_score"] + 7.92) < 1e-9
    assert row["decoding_parameters"]["beam_width"] == "1"
    second = spark.createDataFrame(
        [("", 0, ">>> Shallow slogan answer ===>", -0.1, True),
         ("", 1, "State assumptions and boundary conditions before giving a concise technical example.", -0.3, True)],
        SCRIPT,
    )
    scorer = rule_scorer(["assumptions", "boundary"], ["===>", "slogan"])
    (found,) = rows(selection.lookahead(prompts(spark), selection.scripted_expander(second), scorer, budget=8))
    assert abs(found["final_score"] - 1.81) < 1e-9 and found["verifier_call_count"] == 2
    assert found["final_answer"].startswith("State assumptions and boundary")


def plain_beam(script, score, width, count, beta, steps, lw, rw):
    """Straight reading of the beam definition for one prompt."""
    beams, calls, trace = [("", 0.0, 0.0, False)], 0, []
    for _ in range(steps):
        found = []
        for text, logprob, total, done in beams:
            entries = script.get(text, script.get("", []))[:count]
            if done or not entries:
                found.append((text, logprob, total, True))
                continue
            for more, extra, complete in entries:
                new = text + more
                words, lines = len(new.split()), [x.strip() for x in new.splitlines() if x.strip()]
                calls += 1
                value = logprob + extra + beta * score(new) - lw * words / 100.0 - rw * (len(lines) - len(set(lines)))
                found.append((new, logprob + extra, value, complete))
        found.sort(key=lambda b: -b[2])
        beams = found[:width]
        trace.append(len(found))
        if all(b[3] for b in beams):
            break
    return beams[0][0].strip(), beams[0][2], calls, trace


def test_beam_equals_plain_reading_on_random_scripts(spark):
    rng = random.Random(11)
    words = ["good ", "bad ", "line\n", "line\n", "x", " end"]

    def score(text):
        return text.count("good") - text.count("bad") + min(len(text.split()) / 100.0, 0.25)

    class Counter:
        def score(self, prompt, answer):
            return answer.count("good") - answer.count("bad") + min(len(answer.split()) / 100.0, 0.25)

    for trial in range(3):
        script = {"": [(rng.choice(words), -rng.random(), rng.random() < 0.3) for _ in range(3)]}
        for prefix in [e[0] for e in script[""]]:
            script[prefix] = [(rng.choice(words), -rng.random(), rng.random() < 0.5) for _ in range(rng.randint(0, 3))]
        table = [(p, i, *e) for p, es in script.items() for i, e in enumerate(es)]
        table += [(p, None, None, None, None) for p, es in script.items() if not es]
        expander = selection.scripted_expander(spark.createDataFrame(table, SCRIPT))
        got = rows(
            selection.beam(prompts(spark, 3), expander, client_scorer(Counter), beam_width=2, expansions=3, beta=1.5,
                           max_steps=3, length_weight=0.15, repeat_weight=0.5)
        )
        answer, value, calls, trace = plain_beam(script, score, 2, 3, 1.5, 3, 0.15, 0.5)
        assert len(got) == 3
        for row in got:
            assert (row["final_answer"], row["verifier_call_count"]) == (answer, calls)
            assert abs(row["final_score"] - value) < 1e-9
            assert [len(s["candidates"]) for s in row["steps"]] == trace


def plain_tree_search(tree, count, budget, weight):
    """Visit-by-visit reading of the search that the two-level lookahead condenses."""
    children = [dict(total=t, done=d, below=None, visits=0, value=0.0) for t, d, _ in tree]
    calls = len(children)
    for _ in range(budget):
        total = max(1, sum(c["visits"] for c in children))

        def bound(c):
            return math.inf if not c["visits"] else c["value"] / c["visits"] + weight * math.sqrt(math.log(total + 1) / c["visits"])

        i = max(range(len(children)), key=lambda k: bound(children[k]))
        child = children[i]
        if not child["done"] and not child["below"]:
            child["below"] = tree[i][2]
            calls += len(tree[i][2])
        child["visits"] += 1
        child["value"] += max(child["below"]) if child["below"] else child["total"]
    best = max(range(len(children)), key=lambda k: (round(children[k]["value"] / children[k]["visits"], 9) if children[k]["visits"] else children[k]["total"], children[k]["total"]))
    return best, calls


def test_lookahead_equals_the_visit_by_visit_search(spark):
    rng = random.Random(4)
    trees, level1, level2 = {}, [], []
    for p in range(60):
        tree = [(rng.randint(-5, 5) / 2, rng.random() < 0.4, [rng.randint(-6, 6) / 2 for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 5))]
        trees[f"p{p}"] = tree
        for i, (total, done, below) in enumerate(tree):
            level1.append((f"p{p}", i, f"answer {i}", 0.0, total))
            if not done:
                level2 += [(f"p{p}", i, 0.0, value) for value in below]
    a = spark.createDataFrame(level1, "prompt_id STRING, ord INT, text STRING, logprob DOUBLE, reward DOUBLE")
    b = spark.createDataFrame(level2, "prompt_id STRING, parent_ord INT, logprob DOUBLE, reward DOUBLE")
    for budget in (2, 8):
        got = {r["prompt_id"]: r for r in rows(selection.lookahead_select(a, b, budget))}
        for name, tree in trees.items():
            best, calls = plain_tree_search(tree, 4, budget, 1.4)
            assert got[name]["final_answer"] == f"answer {best}", (name, budget)
            assert got[name]["verifier_call_count"] == calls


def test_lookahead_asks_once_for_each_level(spark, tmp_path):
    """A call for each prompt and one for each open child, whatever the plan reads twice."""
    log = str(tmp_path / "calls")

    class Client:
        def expand(self, prompt, prefix, count):
            with open(log, "a") as out:
                out.write(f"{prompt}|{prefix}\n")
            return [(f"{prefix} open", -1.0, False), (f"{prefix} ended", None, True), (f"{prefix} unknown", -2.0, None)]

    found = rows(selection.lookahead(prompts(spark, 3), selection.client_expander(Client), rule_scorer(["ended"], []), beta=2.0))
    assert len(found) == 3 and all(r["verifier_call_count"] == 9 for r in found)
    with open(log) as calls:
        asked = calls.read().splitlines()
    assert len(asked) == 3 + 3 * 2 and len(set(asked)) == len(asked)


def test_every_row_of_a_shared_id_has_its_own_result(spark):
    class Client:
        def expand(self, prompt, prefix, count):
            return [(f"{prompt} {len(prefix)} a", -1.0, False), (f"{prompt} b", -2.0, True)]

    asked = [("p", "x"), ("p", "yy"), ("p", "yy"), ("p", None), (None, "x"), ("q", "x")]
    table = spark.createDataFrame(asked, "prompt_id STRING, prompt STRING").repartition(3)
    expander, scorer = selection.client_expander(Client), rule_scorer(["b"], [])
    for run in (lambda t: selection.lookahead(t, expander, scorer), lambda t: selection.beam(t, expander, scorer, max_steps=2)):
        found = rows(run(table))
        assert sorted(((r["prompt_id"], r["prompt"]) for r in found), key=str) == sorted(asked, key=str)
        alone = {a: rows(run(spark.createDataFrame([a], table.schema)))[0] for a in asked if a[1]}
        for r in found:
            if r["prompt"]:
                same = alone[r["prompt_id"], r["prompt"]]
                assert all(r[c] == same[c] for c in ("final_answer", "final_score", "verifier_call_count"))


def test_lookahead_records_join_those_of_the_beam(spark):
    class Client:
        def expand(self, prompt, prefix, count):
            if prompt == "Question 1?":
                return []
            return [(f" {'more ' if prefix else ''}good {i}", -float(i), False) for i in range(count)]

    expander, scorer = selection.client_expander(Client), rule_scorer(["good", "more"], [])
    looked = selection.lookahead(prompts(spark, 2), expander, scorer, expansions=2, budget=1)
    beam = selection.beam(prompts(spark, 2), expander, scorer, beam_width=1, expansions=2, max_steps=1)
    records = selection.inference_records(looked, "g", "v").unionByName(selection.inference_records(beam, "g", "v"))
    found = {(r["prompt_id"], r["method"]): r for r in rows(records)}
    first, none = found["p0", "ttc_mcts"], found["p1", "ttc_mcts"]
    assert [b["text"] for b in first["branch_scores"]] == [" good 0", " good 1"]
    best, other = first["branch_values"]
    assert best > first["branch_scores"][0]["total_score"] and other == first["branch_scores"][1]["total_score"]
    assert first["verifier_call_count"] == 4 and first["latency_ms"] > 0.0
    assert first["decoding_parameters"] == {"expansions_per_node": "2", "simulation_budget": "1", "beta": "1.0"}
    assert (none["final_answer"], none["branch_scores"], none["branch_values"]) == ("", [], []) and none["latency_ms"] > 0.0
    assert found["p0", "ttc_beam"]["branch_values"] == []


def test_lookahead_missing_numbers(spark):
    first = spark.createDataFrame([("p0", 0, "a", None, 3.0), ("p0", 1, "b", -1.0, 1.0)], "prompt_id STRING, ord INT, text STRING, logprob DOUBLE, reward DOUBLE")
    below = spark.createDataFrame([], "prompt_id STRING, parent_ord INT, logprob DOUBLE, reward DOUBLE")
    (row,) = rows(selection.lookahead_select(first, below))
    assert (row["final_answer"], row["final_score"]) == ("a", 3.0)
    with pytest.raises(Exception, match="no score"):
        rows(selection.lookahead_select(first.withColumn("reward", F.lit(None).cast("double")), below))


def test_no_continuations_and_bad_settings(spark):
    empty = selection.scripted_expander(spark.createDataFrame([], SCRIPT))
    (row,) = rows(selection.beam(prompts(spark), empty, rule_scorer(), max_steps=2))
    assert (row["final_answer"], row["final_score"], row["verifier_call_count"]) == ("", 0.0, 0)
    assert row["branches"][0]["stopped_reason"] == "no_expansions"
    (row,) = rows(selection.lookahead(prompts(spark), empty, rule_scorer()))
    assert (row["final_answer"], row["final_score"], row["verifier_call_count"]) == ("", 0.0, 0)
    with pytest.raises(ValueError):
        selection.beam(prompts(spark), empty, rule_scorer(), beam_width=0)
    with pytest.raises(ValueError):
        selection.beam(prompts(spark), empty, rule_scorer(), repeat_weight=-1.0)


def test_client_expander(spark):
    class Two:
        def expand(self, prompt, prefix, count):
            return [] if prefix else [(f" {prompt} a", -0.1, False), (f" {prompt} good", -0.2, True)]

    found = rows(selection.beam(prompts(spark, 2), selection.client_expander(Two), rule_scorer(["good"]), beam_width=2, max_steps=3), "prompt_id")
    assert [r["final_answer"] for r in found] == ["Question 0? good", "Question 1? good"]
    assert [len(r["steps"]) for r in found] == [2, 2]


def test_ucb(spark):
    df = spark.createDataFrame([("p", 0, 3, 6.0), ("p", 1, 1, 1.0), ("p", 2, 0, 0.0)], "prompt_id STRING, ord INT, visits INT, value_sum DOUBLE")
    got = rows(selection.ucb_rank(df, 1.4), "place")
    assert [r["ord"] for r in got] == [2, 0, 1]
    assert abs(got[1]["ucb"] - (2 + 1.4 * math.sqrt(math.log(5) / 3))) < 1e-12


def test_records_and_traces(spark):
    candidates = spark.createDataFrame(
        [("p", 0, "bad", 0.0, True), ("p", 1, "good", 0.0, True), ("p", 2, "good too", 0.0, True)],
        "prompt_id STRING, ord INT, text STRING, logprob DOUBLE, is_complete BOOLEAN",
    )
    records = selection.inference_records(selection.rerank(candidates, rule_scorer(["good"]), beam_width=2), "gen", "ver")
    row = records.select(
        "generator_token_count",
        selection.first_trace_item(F.col("step_traces"), "kept")["text"].alias("kept"),
        selection.first_trace_item(F.col("step_traces"), "pruned")["text"].alias("pruned"),
        selection.extreme_branch(F.col("branch_scores"))["text"].alias("best"),
    ).first()
    assert (row.generator_token_count, row.kept, row.pruned, row.best) == (None, "good too", "bad", "good too")
    assert [r["text"] for r in rows(selection.trace_branches(records, "kept"), "place")] == ["good too", "good"]
    assert [r["text"] for r in rows(selection.trace_branches(records, "pruned"))] == ["bad"]
    studied = records.withColumn("seq", F.lit(1)).unionByName(
        records.withColumns({"seq": F.lit(0), "branch_scores": F.slice("branch_scores", 1, 0)})
    )
    assert selection.case_study_row(studied).first().seq == 1


def test_rerank_keeps_every_candidate(spark):
    columns = "prompt_id STRING, prompt STRING, ord INT, text STRING, logprob DOUBLE, is_complete BOOLEAN"
    entries = [(0, "plain a", -1.0, True), (0, "plain b", -1.0, True), (1, "plain c", None, None), (9, "good end", -0.5, True)]
    candidates = spark.createDataFrame([("p", "q", *e) for e in entries], columns)
    (got,) = rows(selection.rerank(candidates, rule_scorer(["good"]), beam_width=4))
    assert got["verifier_call_count"] == 4 and len(got["branches"]) == 4
    assert got["final_answer"] == "good end"
    unknown = next(b for b in got["branches"] if b["text"] == "plain c")
    assert unknown["generator_logprob"] == 0.0 and unknown["is_complete"] is False


def test_losses_are_complete(spark):
    from pairwright.operators import compare

    table = [(i, str(i), m, float(s)) for i in range(70) for m, s in (("new", 0), ("old", 1))]
    scores = spark.createDataFrame(table, "seq LONG, prompt_id STRING, method STRING, score DOUBLE")
    assert compare.losses(scores, "new", ["old"]).count() == 70
    assert len(compare.pairwise(scores, "new", ["old"]).first().loss_ids) == 50
