"""Queries over tables as a cluster keeps them: folders of files, the last prompt cut off by the table's end."""

import re

import pytest
from pyspark.sql import Window, functions as F

from pairwright.operators import joins
from pairwright.streaming import incremental
from querybook.registry import METHODS, QUERIES, val_pairs_of, view
from tests.conftest import rows

DOCUMENTS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def documents(spark, path, n, files=2, blank=()):
    made = [(i, " " if i in blank else f"The answer {i}\nof some words", ("en", "de", "fr", "es")[i // 4 % 4], f"src{i % 5}", 30) for i in range(n)]
    spark.createDataFrame(made, DOCUMENTS).repartition(files).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("n, blank", [(40, ()), (42, ()), (40, (7,))])
def test_evaluation_starts_for_the_prompts_that_all_methods_have_answered(spark, tmp_path, n, blank):
    found = rows(QUERIES["complete_evaluation"](spark, documents(spark, tmp_path, n, blank=blank)), "method")
    assert [r["method"] for r in found] == sorted(METHODS)
    assert sum(r["count"] for r in found) == n and not any(r["early"] for r in found)


def test_evaluation_waits_if_no_prompt_is_finished(spark, tmp_path):
    assert rows(QUERIES["complete_evaluation"](spark, documents(spark, tmp_path, 3))) == []


def test_a_folder_of_files_and_a_single_file_are_streamed_alike(spark, tmp_path):
    path = documents(spark, tmp_path, 42, files=3)
    assert QUERIES["stream_first_per_prompt"](spark, path).count() == 11
    assert QUERIES["stream_scores"](spark, path).count() == 42
    assert sum(r["count"] for r in rows(QUERIES["stream_method_tables"](spark, path))) == 42
    (tmp_path / "one").mkdir()
    part = sorted((tmp_path / "documents.parquet").glob("*.parquet"))[0]
    (tmp_path / "one" / "documents.parquet").write_bytes(part.read_bytes())
    one = incremental.stream_parquet(spark, str(tmp_path / "one"), "documents*.parquet", DOCUMENTS)
    incremental.append_to(one, f"{tmp_path}/out", f"{tmp_path}/log", sink="parquet").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(str(part)).count() > 0


def test_streamed_parts_are_written_by_every_task(spark, tmp_path, monkeypatch):
    path, shared = documents(spark, tmp_path / "in", 60, files=3), tmp_path / "shared"
    monkeypatch.setattr("querybook.registry.fresh_dir", lambda spark, name: str(shared))
    found = rows(QUERIES["stream_completeness"](spark, path), "method")
    assert [(r["method"], r["answered"], r["missing"]) for r in found] == [("penalty", 15, 0), ("raw", 15, 0), ("sft", 15, 0)]
    assert len(list(shared.glob("in/part=3/*.parquet"))) > 1  # one task would write one file


def labelled(spark, path, n):
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")


def test_labelled_pairs_are_those_of_the_view_joined_by_place(spark, tmp_path, capsys):
    path = documents(spark, tmp_path, 200)
    labelled(spark, path, 180)
    pairs = val_pairs_of(spark, path)
    want = view(spark, path, "outputs", "scores", "val_pairs")
    assert pairs.columns == want.columns and pairs.dtypes == want.dtypes
    assert rows(pairs, "prompt_id") == rows(want, "prompt_id") and want.count() == 60
    # the language alone is no join key: good and bad ones of a language would all meet
    pairs.explain()
    joined = [line for line in capsys.readouterr().out.splitlines() if "Join" in line]
    assert any("nth" in line for line in joined) and not any(re.search(r"SortMergeJoin \[lang#\d+\], ", line) for line in joined)


def test_places_are_those_of_one_window(spark):
    made = [(("a", "b", None)[i * 7 % 3], i * 37 % 1000 - 500, i) for i in range(300)]
    df = spark.createDataFrame(made, "k STRING, o LONG, i INT")
    want = df.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert rows(joins.numbered(df, ["k"], "o", block=16), "i") == rows(want, "i")
