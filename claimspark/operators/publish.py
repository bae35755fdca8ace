"""Rows for publishing: nine text properties with limited length and allowed options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import CATEGORIES, STORE_STATUSES

MAX_CHARS = 2000
# Allowed options of the select properties, and their defaults.
OPTIONS = {
    "Fact Status": STORE_STATUSES,
    "Classification": CATEGORIES,
    "Confidence": ["High", "Medium", "Low"],
}
DEFAULTS = {"Fact Status": "Unclear", "Classification": "Other", "Confidence": "Medium"}
# Properties in order with their kinds.
PROPERTIES = {
    "Title": "title",
    "URL": "url",
    "Content": "rich_text",
    "Summary": "rich_text",
    "Claims": "rich_text",
    "Fact Status": "select",
    "Classification": "select",
    "Confidence": "select",
    "Analysis Date": "date",
}


def target_schema(spark: SparkSession) -> DataFrame:
    """``field, kind, option, position``: properties, and one row per option of a select."""
    rows = [
        (field, kind, option, position)
        for field, kind in PROPERTIES.items()
        for position, option in enumerate(OPTIONS.get(field, [None]), 1)
    ]
    return spark.createDataFrame(rows, "field STRING, kind STRING, option STRING, position INT")


def safe_text(value: Column, max_chars: int = MAX_CHARS) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, max_chars)


def safe_list(values: Column, max_chars: int = MAX_CHARS) -> Column:
    """Non-empty items joined with commas."""
    return safe_text(F.array_join(F.filter(values, lambda v: v != ""), ", "), max_chars)


def select_value(value: Column, field: str) -> Column:
    """The allowed option that equals the stripped value in any case, else the field's default."""
    if field not in OPTIONS:
        return text.strip(value)
    wanted = F.lower(text.strip(value))
    found = F.lit(DEFAULTS[field])
    for option in OPTIONS[field]:
        found = F.when(wanted == option.lower(), option).otherwise(found)
    return found


def run_name(topic: Column, run_ts: Column) -> Column:
    return F.concat_ws("_", topic, F.date_format(run_ts, "yyyyMMdd_HHmmss"))


def store_view(analysed: DataFrame) -> DataFrame:
    """Analysed articles under the names the store, the listing and the publisher read."""
    status = F.col("overall_fact_status")
    bridged = F.when(status == "Unsure", "Unclear").otherwise(status)
    return analysed.withColumns({"fact_myth_status": bridged, "key_claims": F.col("claims")})


def publish_rows(items: DataFrame, run_ts: Column, key: str = "article_id") -> DataFrame:
    """``key``, the nine properties, and ``properties``: them as JSON without the empty ones.

    Empty texts and selects are null; title, url and date are always kept.
    """
    date = F.date_format(run_ts, "yyyy-MM-dd")
    if "analysis_date" in items.columns:
        date = F.coalesce(F.col("analysis_date"), date)

    def unless_blank(c: Column) -> Column:
        return F.when(~text.is_blank(c), c)

    values = {
        "Title": safe_text(F.coalesce("title", F.lit("Untitled"))),
        "URL": F.coalesce("url", F.lit("")),
        "Content": unless_blank(safe_text(F.col("content"))),
        "Summary": unless_blank(safe_text(F.col("summary"))),
        "Claims": unless_blank(safe_list(F.col("key_claims"))),
        "Fact Status": select_value(F.col("fact_myth_status"), "Fact Status"),
        "Classification": select_value(F.col("classification"), "Classification"),
        "Confidence": select_value(F.col("confidence"), "Confidence"),
        "Analysis Date": date,
    }
    rows = items.select(key, *[value.alias(name) for name, value in values.items()])
    return rows.withColumn("properties", F.to_json(F.struct(*[F.col(f"`{p}`") for p in PROPERTIES])))


def publish_counts(rows: DataFrame) -> DataFrame:
    """Rows published: those with a title and a date, which the target requires."""
    ok = F.col("Title").isNotNull() & F.col("`Analysis Date`").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("published"))


def option_counts(rows: DataFrame) -> DataFrame:
    """``field, option, position, n``: how many publish rows have each option of the target's selects, zeros included.

    Fields and options are a fixed few, so the counts and the join are of that size.
    """
    chosen = [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("option")) for f in OPTIONS]
    counts = rows.select(F.inline(F.array(*chosen))).groupBy("field", "option").agg(F.count(F.lit(1)).alias("n"))
    options = target_schema(rows.sparkSession).where("option IS NOT NULL")
    return options.join(counts, ["field", "option"], "left").select("field", "option", "position", F.coalesce("n", F.lit(0)).alias("n"))


def write_publish_rows(
    rows: DataFrame, base: str | None, run: str, folder_each_run: bool = True
) -> str | None:
    """Write to a folder of the run or to one fixed folder; without a target nothing is written."""
    if not base:
        return None
    path = f"{base}/run={run}" if folder_each_run else base
    rows.write.mode("overwrite" if folder_each_run else "append").json(path)
    return path


def article_listing(items: DataFrame) -> DataFrame:
    """Articles as listed, with the listing's defaults for missing fields."""
    defaults = {
        "title": "Untitled Article",
        "fact_myth_status": "Unclear",
        "summary": "No summary available",
        "classification": "Other",
        "confidence": "medium",
    }
    return items.select(
        "article_id",
        "url",
        *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()],
        F.coalesce("key_claims", F.array().cast("array<string>")).alias("key_claims"),
    )
