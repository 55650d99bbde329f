"""Column checks of landed tables."""

from pyspark.sql import DataFrame, functions as F


def check_columns(df: DataFrame, required: list[str], sample: int | None = None, order: str | None = None) -> DataFrame:
    """One row: rows checked, rows with a missing required value, the columns missing, and ok.

    All rows are checked, or the first ``sample`` of them (in ``order`` if given).  A
    column absent from the schema is missing in every row; an empty table is not ok.
    """
    rows = df
    if sample is not None:
        rows = (df.orderBy(order) if order else df).limit(sample)
    gaps = F.array_compact(
        F.array(
            *(F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c) for c in required)
        )
    )
    return (
        rows.select(gaps.alias("gaps"))
        .agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(F.size("gaps") > 0).alias("incomplete_rows"),
            F.array_sort(F.flatten(F.collect_set("gaps"))).alias("missing"),
        )
        .select(
            "checked",
            "incomplete_rows",
            F.array_distinct("missing").alias("missing_columns"),
            ((F.col("checked") > 0) & (F.col("incomplete_rows") == 0)).alias("ok"),
        )
    )
