"""The queries of the corpus operators and the reference SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwright.llm import collocations, decontamination, html_text, language, license_scan, line_dedup, mixing, prefix_trie, resharding, simhash, toxicity, url_filter, vector_dedup
from pairwright.llm.oracles import ORACLES
from pairwright.llm.shared import fold

LANGUAGE_FOLDS, HELD_OUT = 3, 1


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    named = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", named, "contaminated")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), LANGUAGE_FOLDS) == HELD_OUT
    model = language.fit(docs.where(~held_out))
    named = docs.select("doc_id", held_out.alias("held_out"), language.identify(model, F.col("text")).alias("l"))
    return named.select("doc_id", "held_out", "l.lang_pred", "l.score", "l.accepted")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    cleaned = line_dedup.drop_lines(line_dedup.build(docs), docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_digest(F.col("kept_text")).alias("kept_sha256"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), toxicity.FOLDS) == 0).alias("held_out"), toxicity.score_toxicity(model, F.col("text")).alias("t"))
    return scored.select("doc_id", "held_out", "t.score", "t.predicted", "t.passages")


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resharding.per_row(resharding.plan(_table(spark, sf_dir, "documents", "doc_id", "text")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.top_phrases(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    q.__name__: q
    for q in (
        op1_decontamination, op2_language_id, op3_url_filter, op4_source_mixing, op5_line_dedup, op6_simhash_dedup,
        op7_license_scan, op8_toxicity, op9_resharding, op10_vector_dedup,
        op11_phrase_mining, op12_html_extraction, op13_prefix_trie, pipeline,
    )
}

__all__ = ["ORACLES", "QUERIES"]
