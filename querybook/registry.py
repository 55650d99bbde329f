"""The registered queries: each runs an operator over whole given tables."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from pairwright import fixed_values as fixed
from pairwright.functions import text as T
from pairwright.functions.similarity import near_duplicate
from pairwright.functions.values import rule_reward
from pairwright.operators import (
    answer_rules, checks, compare, completeness, criteria, guardrail, joins, preference, requests, scoring,
    selection, splits, tables, training_log,
)
from pairwright.plans import evaluation, preference as preference_plan
from pairwright.schemas import METHOD_OUTPUT, PAIR, PROMPT, empty_map, typed
from pairwright.session import fresh_dir
from pairwright.sources import csv_tables, exports, jsonl, prompts as prompt_sources, score_cache
from pairwright.sources.tables import read_table
from pairwright.streaming import completion, incremental
from querybook.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

METHODS = ["raw", "sft", "beam", "penalty"]
REWARDS, PENALTIES = ["heading", "int x", "the "], ["game changer", "===>"]


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def view(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The last named view; the given tables are read lazily, so only used columns are scanned."""
    sql = with_views(*names)
    for table in ("documents", "labels", "conversations"):
        if f" {table}" not in sql:
            continue
        read_table(spark, f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    last = {"VAL_PAIRS": "val_pairs", "RUNS": "runs"}.get(names[-1].upper(), names[-1])
    return spark.sql(f"{sql} SELECT * FROM {last}")


def outputs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "outputs")


def scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "outputs", "scores")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles at nine digits: the two engines add in different orders."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def shaped(df: DataFrame) -> DataFrame:
    return longs(rounded(df))


# --- text metrics and per-method tables -------------------------------------------------


@query
def text_metrics(spark, sf_dir):
    return longs(tables.with_metrics(outputs_of(spark, sf_dir)).select("prompt_id", "method", *T.METRICS))


@query
def overall_table(spark, sf_dir):
    return shaped(tables.overall_table(outputs_of(spark, sf_dir)))


@query
def error_breakdown(spark, sf_dir):
    return tables.error_breakdown(outputs_of(spark, sf_dir))


@query
def latency_table(spark, sf_dir):
    return shaped(tables.latency_table(outputs_of(spark, sf_dir)))


@query
def static_summary(spark, sf_dir):
    return shaped(evaluation.static_evaluation(outputs_of(spark, sf_dir))[1])


@query
def answer_precedence(spark, sf_dir):
    """Static evaluation where French rows have an ``answer`` besides their final answer."""
    other = F.when(F.col("lang") == "fr", F.concat(F.col("source"), F.lit("\n# Note\n- one\n- two")))
    return shaped(evaluation.static_evaluation(outputs_of(spark, sf_dir).withColumn("answer", other))[1])


@query
def metric_map_summary(spark, sf_dir):
    metrics = F.create_map(
        F.lit("words"), T.word_count(F.col("final_answer")).cast("double"),
        F.when(F.col("lang") == "en", "english_chars").otherwise("other_chars"),
        F.length("final_answer").cast("double"),
    )
    return shaped(tables.summarize_metric_map(outputs_of(spark, sf_dir).withColumn("metrics", metrics)))


@query
def quality_vs_compute(spark, sf_dir):
    width = F.create_map(F.lit("max_steps"), F.lit("1"), F.lit("beam_width"), F.when(F.col("lang") == "en", "4").otherwise("2"))
    df = outputs_of(spark, sf_dir).withColumns(
        {
            "decoding_parameters": F.when(F.col("method").isin("beam", "penalty"), width),
            "final_score": F.when(F.col("lang") == "fr", "n/a").otherwise((F.col("seq") % 11).cast("string")),
        }
    )
    return shaped(tables.quality_vs_compute(df))


@query
def human_review_sheet(spark, sf_dir):
    sheet = tables.human_review_sheet(outputs_of(spark, sf_dir), METHODS)
    return sheet.select(
        "prompt_id", "prompt", "best_method", "notes", *(F.md5(f"{m}_answer").alias(f"{m}_answer_md5") for m in METHODS)
    )


@query
def human_preference(spark, sf_dir):
    return shaped(tables.human_preference_table(view(spark, sf_dir, "outputs", "reviews")))


@query
def metric_join(spark, sf_dir):
    return shaped(evaluation.method_metrics(outputs_of(spark, sf_dir)))


@query
def evaluation_assets(spark, sf_dir):
    assets = evaluation.evaluation_assets(outputs_of(spark, sf_dir), METHODS, "judge")
    return shaped(tables.join_metric_tables(assets["overall"], assets["errors"], assets["latency"]))


@query
def ragged_union(spark, sf_dir):
    df = outputs_of(spark, sf_dir)
    union = csv_tables.union_ragged(tables.error_breakdown(df), tables.latency_table(df))
    return shaped(union)


# --- pairing, splits, joins -------------------------------------------------------------


def pair_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = view(spark, sf_dir, "turns")
    rejected = view(spark, sf_dir, "turns", "rejected")
    prompts = turns.select(
        "prompt_id", "prompt", F.lit("chat").alias("source"),
        F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("metadata"),
    )
    good = turns.select(
        "prompt_id", F.lit("chosen").alias("kind"), F.col("chosen").alias("text"), F.lit("m-good").alias("model"),
        empty_map().alias("metadata"), F.col("turn").alias("seq"),
    )
    bad = rejected.select(
        "prompt_id", F.lit("rejected").alias("kind"), "text", F.lit("m-bad").alias("model"),
        F.create_map(F.lit("source"), F.lit("overridden"), F.lit("defect"), F.length("text").cast("string")).alias("metadata"),
        F.col("turn").alias("seq"),
    )
    return prompts, good, bad


def pairs_of(spark, sf_dir) -> DataFrame:
    return preference.kept_pairs(preference.judge_pairs(*pair_inputs(spark, sf_dir)))


@query
def preference_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir).select(
        "prompt_id", "prompt", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"),
        *(F.col("metadata")[k].alias(k) for k in ("turn", "source", "chosen_model", "rejected_model", "defect")),
    )


@query
def preference_report(spark, sf_dir):
    return preference.preference_report(preference.judge_pairs(*pair_inputs(spark, sf_dir)))


@query
def split_assign(spark, sf_dir):
    return splits.split_by_id(view(spark, sf_dir, "turns").select("prompt_id"), seed=13)


@query
def split_counts(spark, sf_dir):
    split = splits.split_by_id(outputs_of(spark, sf_dir).select("prompt_id"), seed=13)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("prompt_id").alias("ids")
    )


@query
def split_overlap(spark, sf_dir):
    split = splits.split_by_id(outputs_of(spark, sf_dir).select("prompt_id"), seed=13)
    return splits.shared_ids(split).agg(F.count(F.lit(1)).alias("shared_ids"))


def exported_preferences(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Written pairs and written test prompts, both read back with every column an answer could leak into."""
    root = fresh_dir(spark, "preference")
    preference_plan.prepare_preferences(*pair_inputs(spark, sf_dir), root=root)
    pairs = spark.read.schema(f"{PAIR}, split STRING").json(f"{root}/pairs")
    return pairs, jsonl.read_jsonl(spark, f"{root}/test_prompts", PAIR).withColumn("split", F.lit("test"))


@query
def preference_export_leaks(spark, sf_dir):
    """Test prompts never share an id with the exported pairs: checked on the files."""
    pairs, held_out = exported_preferences(spark, sf_dir)
    seen = pairs.select("prompt_id").distinct().withColumn("seen", F.lit(1))
    return held_out.select("prompt_id").join(seen, "prompt_id", "left").agg(
        F.count("seen").alias("leaked"), F.count(F.lit(1)).alias("held_out"), F.lit(pairs.count()).cast("long").alias("exported")
    )


@query
def preference_files(spark, sf_dir):
    """Exported pairs and test prompts, read back; an answer in a test file would show."""
    pairs, held_out = exported_preferences(spark, sf_dir)
    both = pairs.unionByName(held_out)
    return both.select(
        "split", "prompt_id", "prompt", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"),
        F.col("metadata")["turn"].alias("turn"),
    )


@query
def sft_files(spark, sf_dir):
    """Exported fine-tuning rows of train, read back from their files."""
    root = fresh_dir(spark, "sft")
    split, _ = preference_plan.prepare_preferences(*pair_inputs(spark, sf_dir))
    exports.export_sft(split, root, "answers")
    back = jsonl.read_jsonl(spark, f"{root}/train_sft", "instruction STRING, input STRING, output STRING, metadata MAP<STRING,STRING>")
    return back.select("instruction", "input", F.md5("output").alias("output_md5"), F.col("metadata")["prompt_id"].alias("prompt_id"))


@query
def split_leaks(spark, sf_dir):
    """Prompts found in two splits when French penalty answers are put into test by themselves."""
    outputs = outputs_of(spark, sf_dir)
    astray = (F.col("method") == "penalty") & (F.col("lang") == "fr")
    return splits.shared_ids(outputs.withColumn("split", F.when(astray, "test").otherwise("train")))


@query
def last_wins(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return joins.last_by_key(df, ["conv_id"], "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query
def first_wins(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return joins.first_by_key(df, ["conv_id"], "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query
def resume_pending(spark, sf_dir):
    turns, done = view(spark, sf_dir, "turns"), view(spark, sf_dir, "turns", "rejected")
    return joins.pending(turns.select("prompt_id", "prompt"), done)


@query
def prompt_length_filter(spark, sf_dir):
    return preference.within_length(
        view(spark, sf_dir, "turns").select("prompt_id", "prompt"), fixed.MIN_PROMPT_CHARS, fixed.MAX_PROMPT_CHARS
    )


@query
def document_length_filter(spark, sf_dir):
    """Documents short and long enough to serve as prompts."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("prompt"))
    kept = preference.within_length(docs, fixed.MIN_PROMPT_CHARS, fixed.MAX_PROMPT_CHARS)
    return kept.select("doc_id", F.md5("prompt").alias("prompt_md5"))


@query
def first_prompts(spark, sf_dir):
    return selection.first_rows(outputs_of(spark, sf_dir).select("seq", "prompt_id", "method"), 100)


@query
def column_check(spark, sf_dir):
    outputs = outputs_of(spark, sf_dir)
    report = checks.check_columns(outputs, ["prompt_id", "latency_ms", "chosen"], sample=None)
    return report.select("checked", "incomplete_rows", F.array_join("missing_columns", ",").alias("missing_columns"), "ok")


@query
def column_gaps(spark, sf_dir):
    """Rows without a latency are incomplete, all others are not."""
    report = checks.check_columns(outputs_of(spark, sf_dir), ["prompt_id", "final_answer", "latency_ms"])
    return report.select("checked", "incomplete_rows", F.array_join("missing_columns", ",").alias("missing_columns"), "ok")


@query
def blank_answers(spark, sf_dir):
    runs = view(spark, sf_dir, "outputs", "runs")
    return runs.where(T.is_blank(F.col("final_answer"))).groupBy("method").agg(F.count(F.lit(1)).alias("blank"))


# --- requests and training rows ---------------------------------------------------------


@query
def generation_requests(spark, sf_dir):
    prompts = pair_inputs(spark, sf_dir)[0]
    both = requests.generation_requests(prompts, "positive", "gen").unionByName(
        requests.generation_requests(prompts, "negative", "gen")
    )
    return both.select(
        "prompt_id", "source_prompt", F.md5("generation_prompt").alias("generation_prompt_md5"), "model",
        *(F.col("metadata")[k].alias(k) for k in ("turn", "source", "generation_mode")),
    )


@query
def judge_requests(spark, sf_dir):
    return requests.judge_requests(outputs_of(spark, sf_dir), "judge").select(
        "request_id", "prompt_id", "model", F.md5("judge_prompt").alias("judge_prompt_md5"),
        F.col("metadata")["method"].alias("method"),
    )


@query
def answer_records(spark, sf_dir):
    turns = view(spark, sf_dir, "turns")
    mode = F.when(F.col("turn") > 2, "negative").when(F.col("turn") > 0, "positive")
    asked = turns.select(
        "prompt_id", F.col("prompt").alias("source_prompt"), F.lit("gen").alias("model"),
        F.when(mode.isNotNull(), F.create_map(F.lit("generation_mode"), mode)).alias("metadata"),
        F.col("next_text").alias("text"), F.lit(-0.5).alias("logprob"),
        F.create_map(F.lit("finish"), F.lit("stop")).alias("response_metadata"),
    )
    return requests.answer_records(asked).select(
        "prompt_id", "kind", F.md5("text").alias("text_md5"), "model",
        *(F.col("metadata")[k].alias(k) for k in ("generation_mode", "source_prompt", "generator_logprob", "finish")),
    )


@query
def rm_export(spark, sf_dir):
    return requests.reward_rows(pairs_of(spark, sf_dir)).select(
        "instruction", "input", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"),
        F.col("metadata")["prompt_id"].alias("prompt_id"),
    )


@query
def sft_export(spark, sf_dir):
    return requests.sft_rows(pairs_of(spark, sf_dir)).select(
        "instruction", "input", F.md5("output").alias("output_md5"), F.col("metadata")["prompt_id"].alias("prompt_id")
    )


@query
def prompt_assignment(spark, sf_dir):
    """Documents matched with the generated prompts, one prompt after the other."""
    size = len(fixed.TOPIC_CONCEPTS) * len(fixed.SCENARIOS) * len(fixed.OUTPUT_REQUIREMENTS) * len(fixed.TASK_TEMPLATES)
    generated = prompt_sources.generate_prompts(spark, size)
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", F.format_string("taxonomy-%06d", F.col("doc_id") % size + 1).alias("prompt_id")
    )
    return joins.dimension_join(docs, generated, ["prompt_id"], "inner").select(
        "doc_id", "prompt_id", F.md5("prompt").alias("prompt_md5"),
        *(F.col("metadata")[k].alias(k) for k in ("topic", "task_type")),
    )


# --- merge, completeness, comparison ----------------------------------------------------


def run_inputs(spark, sf_dir):
    runs = view(spark, sf_dir, "outputs", "runs")
    expected = spark.sql(f"{with_views('outputs', 'runs')} SELECT * FROM expected")
    return expected, {m: (runs.where(F.col("method") == m).drop("method"), "final_answer") for m in METHODS}


@query
def completeness_by_method(spark, sf_dir):
    report = completeness.completeness_report(*run_inputs(spark, sf_dir))
    lists = ("missing", "extra", "duplicates", "empty")
    return report.select(
        *(c for c in report.columns if c not in lists), *(F.array_join(c, ",").alias(c) for c in lists)
    )


@query
def completeness_overall(spark, sf_dir):
    return completeness.overall_completeness(completeness.completeness_report(*run_inputs(spark, sf_dir)))


@query
def completeness_file(spark, sf_dir):
    """The overall verdict written as a JSON summary and read back."""
    path = fresh_dir(spark, "summary")
    jsonl.write_summary(completeness.overall_completeness(completeness.completeness_report(*run_inputs(spark, sf_dir))), path)
    return jsonl.read_summary(spark, path, "merged_rows BIGINT, ok BOOLEAN")


@query
def defect_ids(spark, sf_dir):
    """Every missing, extra, repeated id and every blank answer."""
    return completeness.defect_ids(*run_inputs(spark, sf_dir))


@query
def complete_evaluation(spark, sf_dir):
    """The evaluation waits for incomplete runs and starts for the prompts that every method has answered."""
    outputs = outputs_of(spark, sf_dir)
    finished = completeness.finished_prompts(outputs, METHODS)
    whole = outputs.join(finished, "prompt_id", "left_semi")
    parts = {m: (whole.where(F.col("method") == m).drop("method"), "final_answer") for m in METHODS}
    expected = whole.where(F.col("method") == "raw").select("prompt_id", "prompt")
    evaluate = lambda: tables.overall_table(outputs)
    unfinished, runs = run_inputs(spark, sf_dir)
    _, early = incremental.evaluate_when_complete(unfinished, lambda: runs, evaluate)
    _, found = incremental.evaluate_when_complete(expected, lambda: parts, evaluate)
    found = evaluate().where("false") if found is None else found  # nothing is finished
    return shaped(found.withColumn("early", F.lit(early is not None)))


@query
def stream_completeness(spark, sf_dir):
    """Outputs that arrive in several parts, some rows late, some twice: each method comes once, when it has answered all."""
    outputs = outputs_of(spark, sf_dir).select("prompt_id", "method", "final_answer", "seq").where("NOT (method = 'beam' AND seq % 50 = 0)")
    root = fresh_dir(spark, "completeness-stream")
    found = None
    for i, part in enumerate(("seq % 3 = 0", "seq % 3 = 1 OR seq % 6 = 0", "seq % 3 = 2", "true")):
        outputs.where(part).write.parquet(f"{root}/in/part={i}")
        if found is None:
            stream = spark.readStream.schema(outputs.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
            found = completion.finished_methods(stream, outputs_of(spark, sf_dir).where("method = 'raw'"))
        # the part's files are one batch; the stream goes on where it stopped
        completion.write_finished(found, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out")


@query
def merged_outputs(spark, sf_dir):
    return shaped(
        completeness.merge_outputs(*run_inputs(spark, sf_dir))
        .withColumn("answer_md5", F.md5("final_answer"))
        .drop("final_answer")
    )


@query
def id_differences(spark, sf_dir):
    expected, outputs = run_inputs(spark, sf_dir)
    return completeness.id_differences(expected, outputs["sft"][0])


@query
def repeated_ids(spark, sf_dir):
    return completeness.repeated_ids(run_inputs(spark, sf_dir)[1]["beam"][0])


@query
def score_summary(spark, sf_dir):
    return shaped(compare.score_summary(scores_of(spark, sf_dir)))


@query
def pairwise(spark, sf_dir):
    found = compare.pairwise(scores_of(spark, sf_dir), "penalty", ["raw", "sft", "beam"])
    return shaped(found.withColumn("loss_ids", F.array_join("loss_ids", ",")))


@query
def losing_prompts(spark, sf_dir):
    """Every prompt that the penalty method loses, against each reference."""
    found = compare.losses(scores_of(spark, sf_dir), "penalty", ["raw", "sft", "beam"])
    return found.select("candidate", "reference", "prompt_id", "mine", "other")


@query
def regressions(spark, sf_dir):
    found = compare.regressions(scores_of(spark, sf_dir), outputs_of(spark, sf_dir), "penalty", "beam")
    return rounded(
        found.select(
            "prompt_id", "margin", *(F.col("scores")[m].alias(f"score_{m}") for m in METHODS), "prompt",
            F.md5("base_answer").alias("base_md5"), F.md5("candidate_answer").alias("candidate_md5"),
        )
    )


@query
def merge_score_compare(spark, sf_dir):
    """Merged runs, rule scores, win/loss table."""
    expected, outputs = run_inputs(spark, sf_dir)
    found = evaluation.merge_score_compare(
        expected, outputs, scoring.rule_scorer(REWARDS, PENALTIES), "penalty", ["raw", "beam"]
    )
    return shaped(found["pairwise"].withColumn("loss_ids", F.array_join("loss_ids", ",")))


# --- scoring and validation -------------------------------------------------------------


def scored_pairs_of(spark, sf_dir):
    return scoring.score_pairs(pairs_of(spark, sf_dir), scoring.rule_scorer(["le", "an", "the"], ["que", "zz"]))


@query
def rule_scored_pairs(spark, sf_dir):
    return rounded(scored_pairs_of(spark, sf_dir).select("prompt_id", "chosen_score", "rejected_score"))


@query
def score_validation(spark, sf_dir):
    return shaped(scoring.validate_scores(scored_pairs_of(spark, sf_dir), 0.5)[0])


@query
def score_failures(spark, sf_dir):
    return rounded(scoring.validate_scores(scored_pairs_of(spark, sf_dir))[1])


@query
def label_validation(spark, sf_dir):
    pairs = val_pairs_of(spark, sf_dir)
    return shaped(
        scoring.validate_scores(
            pairs.withColumnsRenamed({"chosen_text": "chosen", "rejected_text": "rejected"})
        )[0]
    )


@query
def output_scores(spark, sf_dir):
    return rounded(
        scoring.score_outputs(outputs_of(spark, sf_dir), scoring.rule_scorer(REWARDS, PENALTIES))
    )


@query
def client_scores(spark, sf_dir):
    """Scores of a plug-in client, one client per task."""

    class LengthClient:
        def score(self, prompt: str, answer: str) -> float:
            return len(answer) / 10 - len(prompt)

    return rounded(scoring.score_outputs(outputs_of(spark, sf_dir), scoring.client_scorer(LengthClient)))


@query
def generated_answers(spark, sf_dir):
    """Generation through a plug-in client for the prompts without an answer yet."""

    class EchoClient:
        model = "echo"

        def expand(self, prompt: str, prefix: str, count: int):
            return [(f"{len(prompt)} characters", -0.25, {"finish": "stop"})]

    prompts, _, done = pair_inputs(spark, sf_dir)
    asked = requests.generation_requests(prompts, "negative", "gen")
    answers, _ = scoring.run_generation(asked, EchoClient, done)
    return answers.select("prompt_id", "kind", "text", "model", *(F.col("metadata")[k].alias(k) for k in ("turn", "generator_logprob", "finish")))


@query
def resumed_generation(spark, sf_dir):
    """A run stopped after the requests of even length; a second one with its log asks for the others only."""

    def client(name: str):
        class Client:
            model = name

            def expand(self, prompt: str, prefix: str, count: int):
                return [(f"{len(prompt)}", -1.0, {"finish": "stop"})]

        return Client

    asked = requests.generation_requests(pair_inputs(spark, sf_dir)[0], "positive", "gen")
    log = fresh_dir(spark, "generation-log")
    scoring.run_generation(asked.where(F.length("generation_prompt") % 2 == 0), client("first"), log=log)
    answers, errors = scoring.run_generation(asked, client("second"), log=log)
    both = answers.select("prompt_id", "model", F.col("text").cast("long").alias("n_chars")).unionByName(errors.select("prompt_id", F.col("error").alias("model"), F.lit(0).cast("long").alias("n_chars")))
    return both


@query
def generation_errors(spark, sf_dir):
    """A client that never answers requests of odd length: two attempts, then an error row."""

    class PickyClient:
        model = "picky"

        def expand(self, prompt: str, prefix: str, count: int):
            if len(prompt) % 2:
                raise ValueError("odd")
            return [("fine", 0.0, {})]

    asked = requests.generation_requests(pair_inputs(spark, sf_dir)[0], "positive", "gen")
    answers, errors = scoring.run_generation(asked, PickyClient, max_retries=1, sleep=lambda seconds: None)
    return longs(
        answers.select("prompt_id", F.lit(None).cast("int").alias("attempt"), "text").unionByName(
            errors.select("prompt_id", "attempt", F.col("error").alias("text"))
        )
    )


@query
def expanded_prompts(spark, sf_dir):
    """As many continuations as the client gives, also beyond the number asked for."""

    class CountingClient:
        def expand(self, prompt: str, prefix: str, count: int):
            return [(f"{prefix}{i}", -i / 4, i == count) for i in range(len(prompt) % 5)]

    prompts = view(spark, sf_dir, "turns").select("prompt_id", "prompt", F.lit("step ").alias("prefix"))
    grown = selection.client_expander(CountingClient)(prompts, 3)
    return longs(grown.select("prompt_id", "cand_ord", "cand_text", "cand_logprob", "cand_complete"))


@query
def score_cache_growth(spark, sf_dir):
    """Short prompts are scored first; the second call scores only the others."""
    path = fresh_dir(spark, "score-cache")
    pairs = pairs_of(spark, sf_dir).select("prompt_id", "prompt", "chosen", "rejected")
    scorer = scoring.rule_scorer(["le", "an", "the"], ["que", "zz"])
    score_cache.score_with_cache(pairs.where(F.length("prompt") < 200), scorer, path)
    return rounded(score_cache.score_with_cache(pairs, scorer, path).select("prompt_id", "chosen_score", "rejected_score"))


# --- criteria ---------------------------------------------------------------------------


def val_pairs_of(spark, sf_dir):
    """The rows of the view ``val_pairs``; its join has only the language as an equal key, here the place is one too."""
    outputs, scores = outputs_of(spark, sf_dir), scores_of(spark, sf_dir).select("seq", "score")
    labels = read_table(spark, f"{sf_dir}/labels.parquet").where("quality IN (0, 1)").select(F.col("doc_id").alias("seq"), "quality")
    named = outputs.select("seq", "lang").where("lang IS NOT NULL").join(labels, "seq")
    places = joins.numbered(named, ["lang", "quality"], "seq").select("lang", "seq", "quality", "nth")
    good, bad = places.where("quality = 1").drop("quality"), places.where("quality = 0").drop("quality")
    size = good.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    met = bad.join(F.broadcast(size), "lang").withColumn("nth", (F.col("nth") - 1) % F.col("n") + 1)
    met = met.join(good.withColumnRenamed("seq", "good"), ["lang", "nth"]).select(F.col("seq").alias("bad"), "good")
    chosen = outputs.select(F.col("seq").alias("good"), "prompt", F.col("final_answer").alias("chosen_text"))
    rejected = outputs.select(F.col("seq").alias("bad"), F.col("final_answer").alias("rejected_text"))
    found = met.join(chosen, "good").join(scores.toDF("good", "chosen_score"), "good").join(rejected, "bad").join(scores.toDF("bad", "rejected_score"), "bad")
    return found.select(F.col("bad").cast("string").alias("prompt_id"), "prompt", "chosen_text", "rejected_text", "chosen_score", "rejected_score")


@query
def criteria_grid(spark, sf_dir):
    return shaped(criteria.search_criteria(val_pairs_of(spark, sf_dir)))


@query
def criteria_top(spark, sf_dir):
    return shaped(criteria.ranked_criteria(criteria.search_criteria(val_pairs_of(spark, sf_dir)), 10))


@query
def criterion_choice(spark, sf_dir):
    return shaped(criteria.choose_criterion(criteria.search_criteria(val_pairs_of(spark, sf_dir))))


def method_scores_of(spark, sf_dir):
    chosen = spark.range(1).select(*(F.lit(w).alias(n) for n, w in zip(criteria.WEIGHTS, (0.25, 0.05, 1.0))))
    return criteria.score_methods(outputs_of(spark, sf_dir), scores_of(spark, sf_dir), chosen)


@query
def method_scores(spark, sf_dir):
    return shaped(method_scores_of(spark, sf_dir))


@query
def criteria_methods(spark, sf_dir):
    """Criteria search whose winner weighs the method table."""
    return shaped(evaluation.criteria_evaluation(val_pairs_of(spark, sf_dir), outputs_of(spark, sf_dir), scores_of(spark, sf_dir))[2])


@query
def results_table(spark, sf_dir):
    return shaped(
        evaluation.main_results(
            outputs_of(spark, sf_dir), scores_of(spark, sf_dir), method_scores_of(spark, sf_dir), METHODS
        )
    )


@query
def side_effects(spark, sf_dir):
    metrics = evaluation.method_metrics(outputs_of(spark, sf_dir))
    return shaped(tables.side_effects(metrics, compare.score_summary(scores_of(spark, sf_dir)), "beam", "penalty"))


@query
def improvement_gate(spark, sf_dir):
    scores = scores_of(spark, sf_dir)
    complete = completeness.overall_completeness(
        completeness.completeness_report(*run_inputs(spark, sf_dir))
    ).select("ok").scalar()
    won = compare.pairwise(scores, "penalty", ["raw", "sft"])
    return tables.improvement_gate(method_scores_of(spark, sf_dir), won, complete, "penalty", ["raw", "sft"])


@query
def improvement_gate_met(spark, sf_dir):
    """The gate over complete outputs with a candidate whose scores are a hundred higher."""
    outputs = outputs_of(spark, sf_dir)
    raised = F.col("score") + F.when(F.col("method") == "penalty", 100.0).otherwise(0.0)
    scores = scores_of(spark, sf_dir).withColumn("score", raised)
    chosen = spark.range(1).select(*(F.lit(w).alias(n) for n, w in zip(criteria.WEIGHTS, (0.25, 0.05, 1.0))))
    parts = {m: (outputs.where(F.col("method") == m).drop("method"), "final_answer") for m in METHODS}
    expected = outputs.where(F.col("method") == "raw").select("prompt_id", "prompt")
    complete = completeness.overall_completeness(completeness.completeness_report(expected, parts)).select("ok").scalar()
    won = compare.pairwise(scores, "penalty", ["raw", "sft"])
    return tables.improvement_gate(criteria.score_methods(outputs, scores, chosen), won, complete, "penalty", ["raw", "sft"])


# --- guardrail and answer rules ---------------------------------------------------------


def guarded_of(spark, sf_dir):
    return guardrail.guardrail_details(view(spark, sf_dir, "guarded"), prompt_sources.guardrail_prompts(spark, 30))


@query
def guardrail_details(spark, sf_dir):
    return longs(guarded_of(spark, sf_dir))


@query
def guardrail_summary(spark, sf_dir):
    return shaped(guardrail.guardrail_summary(guarded_of(spark, sf_dir)))


@query
def answer_rule_codes(spark, sf_dir):
    checked = answer_rules.validate_answers(view(spark, sf_dir, "outputs", "qa"), kind="beam")
    return checked.select(
        "seq", F.array_join(F.array_sort("failures"), ",").alias("failures"), F.array_join(F.array_sort("warnings"), ",").alias("warnings")
    )


@query
def answer_stats(spark, sf_dir):
    return longs(answer_rules.answer_stats(view(spark, sf_dir, "outputs", "qa"), 1000))


@query
def subject_carry(spark, sf_dir):
    found = answer_rules.carried_subjects(view(spark, sf_dir, "outputs", "qa"), "seq", "text")
    return found.groupBy("subject").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"), F.sum("pos").alias("positions")
    )


# --- selection --------------------------------------------------------------------------


@query
def rerank_best_of_n(spark, sf_dir):
    found = selection.rerank(
        view(spark, sf_dir, "outputs", "candidates"), scoring.rule_scorer(REWARDS, PENALTIES),
        beam_width=2, beta=1.5, length_weight=0.15, repeat_weight=0.5,
    )
    records = selection.inference_records(found, "gen", "rule")
    step = F.col("step_traces")[0]
    return shaped(
        records.select(
            "prompt_id", F.md5("final_answer").alias("answer_md5"), "final_score", "verifier_call_count",
            F.size("branch_scores").alias("kept"), F.size(step["pruned"]).alias("pruned"),
            F.aggregate(step["candidates"], F.lit(0.0), lambda a, b: a + b["total_score"]).alias("total"),
            selection.extreme_branch(F.col("branch_scores"), best=False)["total_score"].alias("worst_kept"),
            F.col("decoding_parameters")["beam_width"].alias("beam_width"),
        )
    )


@query
def lookahead_select(spark, sf_dir):
    level1 = view(spark, sf_dir, "outputs", "candidates").withColumn(
        "reward", rule_reward(F.col("text"), REWARDS, PENALTIES)
    )
    level2 = level1.where(~F.col("is_complete")).select(
        "prompt_id", F.col("ord").alias("parent_ord"), "logprob", "reward", "seq", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    ).select(
        "prompt_id", "parent_ord", (F.col("logprob") - F.col("k") / 4).alias("logprob"),
        (F.col("reward") + F.col("seq") * F.col("k") % 5 - 2).alias("reward"),
    )
    found = selection.lookahead_select(level1, level2, budget=3, beta=1.5)
    return shaped(found.select("prompt_id", F.md5("final_answer").alias("answer_md5"), "final_score", "method", "verifier_call_count"))


@query
def ucb_rank(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    visits = events.groupBy(F.col("user_id").cast("string").alias("prompt_id"), F.length("event_type").alias("size"), "event_type").agg(
        F.count_if(F.col("value") > 5).alias("visits"), F.sum(F.when(F.col("value") > 5, F.col("value"))).alias("value_sum")
    )
    order = F.array_position(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), F.col("event_type"))
    ranked = selection.ucb_rank(visits.withColumn("ord", order.cast("long")))
    return shaped(ranked.withColumn("ucb", F.when(F.col("ucb") == float("inf"), -1.0).otherwise(F.col("ucb"))))


def beam_script(spark, sf_dir) -> DataFrame:
    """Continuations per prompt: whole answers first, then two remarks on each unfinished one."""
    first = view(spark, sf_dir, "outputs", "candidates").select(
        "prompt_id", F.lit("").alias("prefix"), "ord", "text", "logprob", "is_complete"
    )
    remarks = F.array(F.lit(" the heading"), F.lit(" ===> int x"))
    second = first.where(~F.col("is_complete")).select(
        "prompt_id", F.col("text").alias("prefix"), F.posexplode(remarks).alias("ord", "text"),
    ).select("prompt_id", "prefix", "ord", "text", (F.col("ord") * -0.1).alias("logprob"), F.lit(True).alias("is_complete"))
    return first.unionByName(second)


def beam_prompts(spark, sf_dir) -> DataFrame:
    return joins.first_by_key(outputs_of(spark, sf_dir).select("prompt_id", "prompt", "seq"), ["prompt_id"], "seq")


@query
def beam_multi_step(spark, sf_dir):
    found = selection.beam(
        beam_prompts(spark, sf_dir), selection.scripted_expander(beam_script(spark, sf_dir), by_prompt=True),
        scoring.rule_scorer(REWARDS, PENALTIES), beam_width=2, expansions=4, beta=1.5, max_steps=3,
    )
    return shaped(
        found.select(
            "prompt_id", F.md5("final_answer").alias("answer_md5"), "final_score", "verifier_call_count",
            F.size("steps").alias("steps"), F.size("branches").alias("branches"),
        )
    )


@query
def kept_branches(spark, sf_dir):
    found = selection.rerank(
        view(spark, sf_dir, "outputs", "candidates"), scoring.rule_scorer(REWARDS, PENALTIES), beam_width=2
    )
    records = selection.inference_records(found, "gen", "rule")
    kept = selection.trace_branches(records, "kept").select("prompt_id", "place", "total_score", F.md5("text").alias("text_md5"))
    return shaped(kept)


@query
def decode_latency(spark, sf_dir):
    """Cost of a decoding run through a client: its calls take time, which the records keep."""

    class SlowClient:
        def expand(self, prompt: str, prefix: str, count: int):
            time.sleep(0.001)
            return [(f"{prefix and ' '}part {i}", -float(i), len(prefix) > 0) for i in range(count)]

    asked = pair_inputs(spark, sf_dir)[0].select("prompt_id", "prompt")
    found = selection.beam(asked, selection.client_expander(SlowClient), scoring.rule_scorer(["part"]), beam_width=2, expansions=3, max_steps=2)
    records = selection.inference_records(found, "slow", "rule")
    return records.select("prompt_id", (F.col("latency_ms") >= 3.0).alias("took_time"), "verifier_call_count", "final_answer")


@query
def first_traced(spark, sf_dir):
    """First kept and first pruned branch of every record."""
    found = selection.rerank(
        view(spark, sf_dir, "outputs", "candidates"), scoring.rule_scorer(REWARDS, PENALTIES), beam_width=2
    )
    records = selection.inference_records(found, "gen", "rule")
    return records.select(
        "prompt_id", *(F.md5(selection.first_trace_item(F.col("step_traces"), which)["text"]).alias(f"{which}_md5") for which in ("kept", "pruned"))
    )


@query
def case_study(spark, sf_dir):
    """The first record with branches, where those of prompts before '2' have lost theirs."""
    found = selection.rerank(
        view(spark, sf_dir, "outputs", "candidates"), scoring.rule_scorer(REWARDS, PENALTIES), beam_width=2
    )
    records = selection.inference_records(found, "gen", "rule")
    bare = records.withColumn("branch_scores", F.when(F.col("prompt_id") >= "2", F.col("branch_scores")))
    return shaped(selection.case_study_row(bare, "prompt_id").select("prompt_id", F.md5("final_answer").alias("answer_md5"), "final_score"))


@query
def lookahead_scripted(spark, sf_dir):
    found = selection.lookahead(
        beam_prompts(spark, sf_dir), selection.scripted_expander(beam_script(spark, sf_dir), by_prompt=True),
        scoring.rule_scorer(REWARDS, PENALTIES), budget=3, beta=1.5,
    )
    return shaped(found.select("prompt_id", F.md5("final_answer").alias("answer_md5"), "final_score", "verifier_call_count"))


@query
def lookahead_records(spark, sf_dir):
    """Branches of the lookahead's records and of the beam's, read from one table of records."""
    scorer = scoring.rule_scorer(REWARDS, PENALTIES)
    looked = selection.lookahead(
        beam_prompts(spark, sf_dir), selection.scripted_expander(beam_script(spark, sf_dir), by_prompt=True), scorer, budget=3, beta=1.5
    )
    beam = selection.rerank(view(spark, sf_dir, "outputs", "candidates"), scorer, beam_width=2, beta=1.5)
    records = selection.inference_records(looked, "gen", "rule").unionByName(selection.inference_records(beam, "gen", "rule"))
    branches = records.select("prompt_id", "method", "branch_values", "decoding_parameters", F.posexplode("branch_scores").alias("place", "b"))
    return shaped(branches.select(
        "prompt_id", "method", "place", F.md5("b.text").alias("text_md5"), "b.total_score", "b.is_complete",
        F.get("branch_values", F.col("place")).alias("value"), F.col("decoding_parameters")["simulation_budget"].alias("budget"),
    ))


@query
def near_duplicate_answers(spark, sf_dir):
    """Verdict for each assistant message and the user message after it."""
    turns = view(spark, sf_dir, "turns").where(F.col("next_text").isNotNull())
    return turns.select("prompt_id", near_duplicate(F.col("chosen"), F.col("next_text"), 0.4).alias("near_duplicate"))


# --- training logs, formats, streams ----------------------------------------------------


@query
def training_runs(spark, sf_dir):
    """Documents read as run logs: a line of even length is a training loss, of odd length an eval loss."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    entry = lambda line, i: F.create_map(
        F.lit("step"), i.cast("string"),
        F.when(F.length(line) % 2 == 0, "loss").otherwise("eval_loss"), F.length(line).cast("string"),
    )
    states = docs.select(
        F.col("doc_id").cast("string").alias("run"),
        F.col("n_chars").alias("global_step"),
        F.lit(None).cast("double").alias("best_metric"),
        F.lit(None).cast("string").alias("best_model_checkpoint"),
        F.transform(F.split("text", "\n"), entry).alias("log_history"),
    )
    found = training_log.summarize_runs(states)
    return shaped(found.select("run", "global_step", "log_history_count", "last_train_loss", "last_eval_loss", F.col("last_metrics")["step"].alias("last_step"), "ok"))


@query
def jsonl_round_trip(spark, sf_dir):
    path = fresh_dir(spark, "jsonl")
    outputs = outputs_of(spark, sf_dir).withColumns({"source_model": F.lit(""), "source_run_id": F.lit("")})
    jsonl.write_jsonl(outputs, path)
    back = jsonl.read_jsonl(spark, path, METHOD_OUTPUT)
    return rounded(back.select("prompt_id", "method", "latency_ms", "verifier_call_count", F.md5("final_answer").alias("answer_md5")))


@query
def jsonl_appended(spark, sf_dir):
    """Two appends to one table: the answers of each language group."""
    path = fresh_dir(spark, "appended")
    outputs = outputs_of(spark, sf_dir)
    for english in (True, False):
        part = outputs.where((F.col("lang") == "en") == F.lit(english))
        jsonl.append_jsonl(part.select("prompt_id", "method", "final_answer"), path)
    back = jsonl.read_jsonl(spark, path, METHOD_OUTPUT)
    return back.groupBy("method").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.length("final_answer")).alias("chars")
    )


@query
def jsonl_quarantine(spark, sf_dir):
    """French documents are written as plain text lines, all others as JSON lines."""
    path = fresh_dir(spark, "quarantine")
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("prompt_id"), F.col("text").alias("prompt")))
    line = F.when(F.col("lang") == "fr", F.concat(F.lit("plain "), F.regexp_replace("text", "[\\r\\n]", " "))).otherwise(record)
    docs.select(line.alias("value")).write.text(path)
    good, bad = jsonl.read_jsonl_quarantine(spark, path, PROMPT)
    sides = good.select(F.lit("good").alias("side"), F.length("prompt").alias("chars")).unionByName(
        bad.select(F.lit("bad").alias("side"), F.length("line").alias("chars"))
    )
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("count"), F.sum("chars").alias("chars"))


@query
def reward_files(spark, sf_dir):
    """Exported reward-model rows of train and val, read back from their files."""
    root = fresh_dir(spark, "reward")
    split, _ = preference_plan.prepare_preferences(*pair_inputs(spark, sf_dir))
    exports.export_reward(split, root, "pairs")
    schema = "instruction STRING, input STRING, chosen STRING, rejected STRING, metadata MAP<STRING,STRING>"
    parts = [
        jsonl.read_jsonl(spark, f"{root}/{part}_rm", schema).withColumn("split", F.lit(part)) for part in ("train", "val")
    ]
    return parts[0].unionByName(parts[1]).select(
        "split", "instruction", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"),
        F.col("metadata")["prompt_id"].alias("prompt_id"),
    )


@query
def typed_answers(spark, sf_dir):
    """Conversation turns loaded as answer records with defaults."""
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("prompt_id"), F.when(F.col("role") == "assistant", F.col("text")).alias("text"), "turn"
    )
    return typed(raw, "answer", ["turn"]).groupBy("kind", "model").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn")
    )


@query
def csv_round_trip(spark, sf_dir):
    path = fresh_dir(spark, "csv")
    csv_tables.write_csv(path, outputs_of(spark, sf_dir).select("seq", "prompt_id", "method", "latency_ms", "final_answer"))
    back = csv_tables.numbers(csv_tables.read_csv(spark, path), ["latency_ms"])
    return rounded(back.select("seq", "prompt_id", "method", "latency_ms", F.length("final_answer").cast("long").alias("answer_chars")))


@query
def csv_cells(spark, sf_dir):
    """Cells of a written table as whole numbers, other numbers or text."""
    path = fresh_dir(spark, "cells")
    cell = F.when(F.col("lang") == "fr", F.col("source")).when(F.col("lang") == "en", (F.col("n_chars") / 4).cast("string")).otherwise(F.col("n_chars").cast("string"))
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    csv_tables.write_csv(path, docs.select(F.col("doc_id").cast("string").alias("doc_id"), cell.alias("cell")))
    back = csv_tables.number_cells(csv_tables.read_csv(spark, path), ["doc_id", "cell"])
    return back.select(F.col("doc_id.whole").alias("doc_id"), "cell.whole", "cell.number", "cell.text")


@query
def progress_counter(spark, sf_dir):
    """Rows counted while the outputs are written."""
    seen = Observation("outputs")
    path = fresh_dir(spark, "counted")
    incremental.with_progress(outputs_of(spark, sf_dir).select("seq"), seen).write.parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written"), F.lit(seen.get["rows"]).cast("long").alias("rows"))


def streamed_outputs(spark, sf_dir) -> DataFrame:
    """The outputs view over a stream, under a view name of its own."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = incremental.stream_parquet(spark, sf_dir, "documents*.parquet", schema)
    stream.createOrReplaceTempView("streamed_documents")
    return spark.sql(f"{with_views('outputs').replace('FROM documents', 'FROM streamed_documents')} SELECT * FROM outputs")


@query
def stream_method_tables(spark, sf_dir):
    path = fresh_dir(spark, "running")
    incremental.keep_latest(incremental.running_tables(streamed_outputs(spark, sf_dir)), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return shaped(incremental.read_latest(spark, f"{path}/table"))


@query
def stream_scores(spark, sf_dir):
    path = fresh_dir(spark, "scored")
    scored = scoring.score_outputs(streamed_outputs(spark, sf_dir), scoring.rule_scorer(REWARDS, PENALTIES))
    incremental.append_to(scored, f"{path}/scores", f"{path}/checkpoint", sink="parquet").awaitTermination()
    return rounded(spark.read.parquet(f"{path}/scores"))


@query
def stream_first_per_prompt(spark, sf_dir):
    path = fresh_dir(spark, "once")
    once = incremental.once_per_key(streamed_outputs(spark, sf_dir).select("prompt_id"))
    incremental.append_to(once, f"{path}/ids", f"{path}/checkpoint", sink="parquet").awaitTermination()
    return spark.read.parquet(f"{path}/ids")


@query
def stream_users(spark, sf_dir):
    """Users seen in the event stream; an id is forgotten once the watermark has passed it."""
    path = fresh_dir(spark, "users")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = incremental.stream_parquet(spark, sf_dir, "events*.parquet", schema).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    once = incremental.once_per_key(events, "user_id", "ts", "400 days").select("user_id")
    incremental.append_to(once, f"{path}/ids", f"{path}/checkpoint", sink="parquet").awaitTermination()
    return spark.read.parquet(f"{path}/ids")
