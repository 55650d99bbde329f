import json
import os
import time

import pytest

from pairwright import schemas
from pairwright.operators import checks, preference, splits, training_log
from pairwright.operators.scoring import rule_scorer
from pairwright.sources import csv_tables, exports, jsonl, score_cache, trainer_logs
from pairwright.sources.tables import read_table
from tests.conftest import rows

PAIR = "prompt_id STRING, prompt STRING, chosen STRING, rejected STRING, metadata MAP<STRING,STRING>"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)


def lines_of(folder):
    found = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name), encoding="utf-8") as part:
                found += [line for line in part.read().splitlines() if line]
    return found


def test_jsonl_scan_skips_blank_lines_and_fails_on_bad_ones(spark, tmp_path):
    path = f"{tmp_path}/in.jsonl"
    write(path, '{"prompt_id": "p1", "prompt": "a"}\n\n  \n{"prompt_id": "p2", "prompt": "é"}\n')
    assert [r["prompt_id"] for r in rows(jsonl.read_jsonl(spark, path, schemas.PROMPT), "prompt_id")] == ["p1", "p2"]
    write(path, '{"prompt_id": "p1", "prompt": "a"}\n{broken\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, schemas.PROMPT).collect()
    good, bad = jsonl.read_jsonl_quarantine(spark, path, schemas.PROMPT)
    assert [r["prompt_id"] for r in rows(good)] == ["p1"]
    (line,) = rows(bad)
    assert line["line"] == "{broken" and line["file"].endswith("in.jsonl")


def test_jsonl_sinks(spark, tmp_path):
    df = spark.createDataFrame([("z", None, "é")], "b STRING, c STRING, a STRING")
    jsonl.write_jsonl(df, f"{tmp_path}/out")
    assert lines_of(f"{tmp_path}/out") == ['{"a":"é","b":"z","c":null}']
    jsonl.append_jsonl(df, f"{tmp_path}/out")
    assert len(lines_of(f"{tmp_path}/out")) == 2
    numbered = jsonl.with_sequence(jsonl.read_jsonl(spark, f"{tmp_path}/out", "a STRING"))
    assert numbered.select("seq").distinct().count() == 2
    jsonl.write_summary(df, f"{tmp_path}/summary")
    assert len(lines_of(f"{tmp_path}/summary")) == 1
    write(f"{tmp_path}/one.json", '{\n "ok": true,\n "n": 3\n}\n')
    assert jsonl.read_summary(spark, f"{tmp_path}/one.json").first().n == 3


def test_csv(spark, tmp_path):
    a = spark.createDataFrame([("x", 'say "hi",\nthere')], "method STRING, text STRING")
    b = spark.createDataFrame([("y", 1.5)], "method STRING, score DOUBLE")
    csv_tables.write_csv(f"{tmp_path}/t", a, b)
    back = csv_tables.read_csv(spark, f"{tmp_path}/t")
    assert back.columns == ["method", "text", "score"]
    assert rows(back, "method") == [
        {"method": "x", "text": 'say "hi",\nthere', "score": ""},
        {"method": "y", "text": "", "score": "1.5"},
    ]
    assert [r["score"] for r in rows(csv_tables.numbers(back, ["score"]), "method")] == [None, 1.5]


def test_number_cells(spark):
    cells = ["7", " 3.0", "1e3", "2.5", "1.0d", "inf", "1e30", "word", "", None]
    table = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i INT, c STRING")
    found = [tuple(r["c"].values()) for r in rows(csv_tables.number_cells(table, ["c"]), "i")]
    assert found == [
        (7, None, None), (3, None, None), (1000, None, None), (None, 2.5, None), (None, None, "1.0d"),
        (None, float("inf"), None), (None, 1e30, None), (None, None, "word"), (None, None, ""), (None, None, None),
    ]


def pairs(spark, n=10):
    return spark.createDataFrame(
        [(f"p{i}", f"Prompt {i}", f"Chosen {i}", f"Rejected {i}", {"topic": "memory"}) for i in range(n)], PAIR
    )


def test_exports(spark, tmp_path):
    split = splits.split_by_id(pairs(spark), seed=7)
    manifest = exports.export_reward(split, f"{tmp_path}/rm", "pref")
    assert [(r["dataset"], r["file_name"], r["ranking"]) for r in rows(manifest)] == [
        ("pref", "train_rm", True), ("pref_val", "val_rm", True),
    ]
    row = json.loads(lines_of(f"{tmp_path}/rm/train_rm")[0])
    assert set(row) == {"instruction", "input", "chosen", "rejected", "metadata"}
    assert row["metadata"]["topic"] == "memory" and row["metadata"]["prompt_id"].startswith("p")
    assert (len(lines_of(f"{tmp_path}/rm/train_rm")), len(lines_of(f"{tmp_path}/rm/val_rm"))) == (8, 1)
    manifest = exports.export_sft(split, f"{tmp_path}/sft", "pref_sft")
    assert rows(manifest)[0]["columns"] == {"prompt": "instruction", "query": "input", "response": "output"}
    assert "rejected" not in json.loads(lines_of(f"{tmp_path}/sft/train_sft")[0])
    report = spark.createDataFrame([(10, 10, 0, 0, 0)], "total_prompts INT, kept_pairs INT, a INT, b INT, c INT")
    exports.export_preferences(split, report, f"{tmp_path}/pref")
    held_out = [json.loads(x) for x in lines_of(f"{tmp_path}/pref/test_prompts")]
    assert len(held_out) == 1 and set(held_out[0]) == {"prompt_id", "prompt", "metadata"}
    assert sorted(x for x in os.listdir(f"{tmp_path}/pref/pairs") if x.startswith("split")) == ["split=train", "split=val"]


def test_score_cache_scores_only_new_pairs(spark, tmp_path):
    path = f"{tmp_path}/cache"
    scorer = rule_scorer(["chosen 1"])
    first = score_cache.score_with_cache(pairs(spark, 3), scorer, path)
    assert first.count() == 3
    before = spark.read.parquet(path).count()
    second = rows(score_cache.score_with_cache(pairs(spark, 5), scorer, path), "prompt_id")
    assert (before, spark.read.parquet(path).count(), len(second)) == (3, 5, 5)
    assert second[1]["chosen_score"] == 1.02


STATE = {
    "best_metric": 0.42,
    "best_model_checkpoint": "here",
    "global_step": 200,
    "log_history": [{"step": 100, "loss": 1.2, "learning_rate": 1e-5}, {"step": 200, "eval_loss": 0.42, "epoch": 1.0}],
}


def test_trainer_logs(spark, tmp_path):
    root = f"{tmp_path}/runs"
    write(f"{root}/a/trainer_state.json", json.dumps(STATE, indent=1))
    write(f"{root}/a/checkpoint-9/trainer_state.json", json.dumps({**STATE, "global_step": 9}))
    write(f"{root}/b/checkpoint-1/trainer_state.json", json.dumps({**STATE, "global_step": 1}))
    write(f"{root}/b/checkpoint-2/trainer_state.json", json.dumps({**STATE, "global_step": 2, "log_history": []}))
    now = time.time()
    os.utime(f"{root}/b/checkpoint-2/trainer_state.json", (now - 500, now - 500))
    got = rows(training_log.summarize_runs(trainer_logs.read_trainer_states(spark, root)), "run")
    assert [(os.path.basename(r["run"]), r["global_step"]) for r in got] == [("a", 200), ("b", 1)]
    a = got[0]
    assert (a["log_history_count"], a["last_train_loss"], a["last_eval_loss"], a["best_metric"]) == (2, 1.2, 0.42, 0.42)
    assert a["last_metrics"]["eval_loss"] == "0.42" and a["ok"]


def test_column_check(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "instruction STRING, chosen STRING")
    row = checks.check_columns(df, ["instruction", "chosen", "rejected"]).first()
    assert (row.checked, row.incomplete_rows, row.missing_columns, row.ok) == (2, 2, ["chosen", "rejected"], False)
    assert checks.check_columns(df, ["instruction"]).first().ok
    assert not checks.check_columns(df.limit(0), ["instruction"]).first().ok


def test_prompt_length(spark):
    df = spark.createDataFrame([("a" * 19,), ("a" * 20,), ("a" * 801,)], "prompt STRING")
    assert preference.within_length(df, 20, 800).count() == 1


def test_read_table_keeps_the_stored_splits(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = read_table(spark, f"{tmp_path}/t")
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString() and table.count() == 100


def test_score_cache_goes_by_content(spark, tmp_path):
    path, scorer = f"{tmp_path}/cache", rule_scorer(["good"])
    columns = "prompt_id STRING, prompt STRING, chosen STRING, rejected STRING"
    first = spark.createDataFrame([("a", "q", "good", "x"), ("a", "q", "plain", "x"), ("a", "q", "good", "x")], columns)
    assert score_cache.score_with_cache(first, scorer, path).count() == 3
    assert spark.read.parquet(path).count() == 2
    changed = spark.createDataFrame([("a", "q", "plain", "good")], columns)
    row = score_cache.score_with_cache(changed, scorer, path).first()
    assert row.chosen_score < row.rejected_score and (row.chosen, row.rejected) == ("plain", "good")
