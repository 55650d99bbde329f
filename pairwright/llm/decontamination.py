"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows become a hash set that meets every window of every document
in a broadcast join (beyond a checked size: in a shuffled join); hits are verified word by
word, and gathered per document.
"""

from pyspark.sql import Column, DataFrame, functions as F

from pairwright.llm.shared import ascii_lower, keyed, replaced, same

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"  # a word of any case and what follows it
LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
BROADCAST_WINDOWS = 1_000_000
BROADCAST_BYTES = 128 << 20
REPORT = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]


def words(text: Column) -> Column:
    """Lower-cased words; splitting costs a fifth of extracting them by pattern."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """(``hash``, ``width``, ``window``, ``items``) of the distinct windows; a short item is one window."""
    item = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(n))
    return (
        item.select("item_id", "w", width.alias("width"), F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)).alias("at"))
        .select("item_id", "width", F.slice("w", F.col("at"), F.col("width")).alias("window"))
        .groupBy("window", "width")
        .agg(F.collect_set("item_id").alias("items"))
        .select(F.xxhash64("window").alias("hash"), "width", "window", "items")
    )


def _held_bytes() -> Column:
    """What a window takes in memory: its words and items, and what each of them costs besides."""
    texts = F.octet_length(F.array_join("window", "")) + F.octet_length(F.array_join(F.col("items").cast("array<string>"), ""))
    return (texts + 16 * (F.size("window") + F.size("items")) + 64).cast("long")


def _covered(hits: Column) -> Column:
    """Words in the union of the hit windows."""

    def step(state: Column, hit: Column) -> Column:
        start, end = F.greatest(hit["at"], state["end"]), hit["at"] + hit["width"]
        return F.struct((state["n"] + F.greatest(end - start, F.lit(0))).alias("n"), F.greatest(end, state["end"]).alias("end"))

    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document row: ``doc_id``, ``digest``, ``n_words``, ``n_hit``, ``n_items``, ``item_ids``, ``hits``, ``contaminated``.

    ``hits`` holds (at, width) of the verified windows, 1-based word positions.  A null or
    wordless text has no words and no hits; items without words match nothing; an item
    without id marks words but is not counted among the items; repeated rows are reported
    one by one; empty tables give no rows, or no hits.  Each row carries its own marker
    through the join, so the texts are read once and only counts and hits are shuffled.
    """
    sought = windows(benchmark, n)
    widths = [r.width for r in sought.select("width").distinct().sort("width").collect()]  # at most n numbers
    held = sought.agg(F.count(F.lit(1)).alias("rows"), F.sum(_held_bytes()).alias("bytes")).first()
    small = held.rows <= broadcast_windows and (held.bytes or 0) <= BROADCAST_BYTES
    sought = sought.select("hash", F.col("width").alias("sought_width"), "window", "items")

    doc = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row_id"), words(F.col("text")).alias("w"))
    # position 0 is the row's marker; the windows of each width follow
    at = doc.select("*", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    if len(widths) <= 1:
        at = at.withColumn("width", F.lit(widths[0] if widths else n))
    else:
        at = at.withColumn("width", F.explode(F.when(F.col("at") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, widths)))))
    fits = (F.col("at") == 0) | (F.col("at") + F.col("width") - 1 <= F.size("w"))
    # from here on a row holds its own window only, however long the text is
    at = at.where(fits).select(
        "doc_id", "digest", "row_id", "at", "width", F.when(F.col("at") == 0, F.size("w")).alias("n_words"),
        F.when(F.col("at") > 0, F.slice("w", F.greatest("at", F.lit(1)), F.col("width"))).alias("own"),
    ).withColumn("hash", F.when(F.col("at") > 0, F.xxhash64("own")).otherwise(F.xxhash64("row_id")))
    # a marker's hash only spreads it: it has no window of its own, so it never is a hit
    met = at.join(F.broadcast(sought) if small else sought, "hash", "left")
    is_hit = F.col("window").isNotNull() & (F.col("width") == F.col("sought_width")) & (F.col("own") == F.col("window"))
    kept = met.select(
        "doc_id", "digest", "row_id", "n_words", F.when(is_hit, F.struct("at", "width")).alias("hit"), F.when(is_hit, F.col("items")).alias("items")
    ).where("n_words IS NOT NULL OR hit IS NOT NULL")
    per_row = kept.groupBy("row_id", "doc_id", "digest").agg(
        F.max("n_words").cast("long").alias("n_words"), F.collect_list("hit").alias("hits"), F.collect_set("items").alias("items")
    )
    items = F.array_sort(F.array_distinct(F.flatten("items")).cast("array<string>"))
    return per_row.select(
        "doc_id", "digest", "n_words", _covered(F.col("hits")).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), "hits", (F.size("hits") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """The documents without any hit; repeated rows of a hit text go together, all other rows and columns stay."""
    hit = contamination(docs, benchmark, n).where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).distinct()
    rows = keyed(docs)
    return rows.join(hit, same(rows, hit, {"doc_id": "hit_id", "digest": "hit_digest"}), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """Cut the hit words, each with the separators behind it, out of the texts; adds n_words, n_hit, n_items, item_ids, contaminated.

    A hit text keeps its case and punctuation outside the cut words; untouched texts stay
    byte for byte.  Input columns with the names of the report are replaced.
    """
    report = contamination(docs, benchmark, n).groupBy("doc_id", "digest").agg(*(F.first(c).alias(c) for c in [*REPORT, "hits"]))
    report = report.withColumnsRenamed({"doc_id": "hit_id", "digest": "hit_digest"})
    rows = keyed(replaced(docs, REPORT))
    met = rows.join(report, same(rows, report, {"doc_id": "hit_id", "digest": "hit_digest"}), "left")
    text = F.col("row.text")
    cut = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["width"] - 1))))
    kept = F.filter(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda piece, i: ~F.array_contains("cut", i + 1))
    met = met.withColumn("cut", cut)
    cleaned = F.when(F.col("contaminated"), F.concat(F.regexp_extract(text, LEAD, 0), F.array_join(kept, ""))).otherwise(text)
    fields = [cleaned.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in replaced(docs, REPORT).columns]
    return met.select(*fields, *REPORT)


