"""Incident selection, breakdown, timeline and the two report forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.text import filled
from parapet.lexicon import REPORT_ROWS_MAX
from parapet.operators.filters import AuditFilter
from parapet.operators.listing import late_rows, newest_first
from parapet.operators.metrics import label_counts
from parapet.session import cut_lineage


def select_incidents(
    df: DataFrame, flagged_only: bool = True, limit: int = 200, most: int = REPORT_ROWS_MAX,
    **filters: str | None,
) -> DataFrame:
    """The newest (flagged) rows that pass the filters; limit within 1..``most``."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be within 1..{most}")
    chosen = AuditFilter(flagged=True if flagged_only else None, **filters)
    return chosen.apply(df).orderBy(*newest_first()).limit(limit)


def risk_breakdown(df: DataFrame) -> DataFrame:
    """Label counts over the flagged rows."""
    return label_counts(df.filter("flagged"))


def timeline(df: DataFrame, *keep: str) -> DataFrame:
    """One line per flagged row: time, id, labels, first explanation."""
    risk = filled(F.array_join("risk_labels", ", "), "none")
    explanation = F.coalesce(F.get("risk_explanations", F.lit(0)), F.lit(""))
    # concat, not concat_ws: an empty explanation still leaves its separator
    line = F.concat(
        F.lit("- "),
        F.coalesce("timestamp", F.lit("None")),
        F.lit(" | #"),
        F.col("id").cast("string"),
        F.lit(" | "),
        risk,
        F.lit(" | "),
        explanation,
    )
    return df.filter("flagged").select("id", "timestamp", *keep, line.alias("line"))


def shown_filters(flagged_only: bool, limit: int, filters: dict) -> dict[str, str]:
    """The filters in effect, in the order and spelling the report lists them."""
    names = ["project_name", "model_name", "user_id", "risk_label", "start_date", "end_date"]
    values = {"flagged_only": flagged_only}
    values.update({n: filters.get(n) for n in names})
    values["limit"] = limit
    return {k: str(v) for k, v in values.items() if v not in (None, "")}


def report_lines(
    df: DataFrame,
    generated_at: str,
    flagged_only: bool = True,
    limit: int = 200,
    **filters: str | None,
) -> DataFrame:
    """The markdown report as ``(section, rank, part, line)`` rows.

    The selection is a distributed top-k over the whole stored table. Its rows, at most
    2000, are written once, as four sections read them.
    """
    # Headings and line formats of the report, here and below.
    spark = df.sparkSession
    chosen_rows = select_incidents(df, flagged_only, limit, **filters)
    rows = cut_lineage(late_rows(df, chosen_rows), "incidents")
    flagged = rows.filter("flagged")
    ranked = flagged.withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*newest_first()))
    )

    def fixed_lines(section: int, lines: list[str]) -> DataFrame:
        data = [(section, 0, i, text) for i, text in enumerate(lines)]
        return spark.createDataFrame(data, "section int, rank int, part int, line string")

    chosen = shown_filters(flagged_only, limit, filters)
    head = fixed_lines(
        0, ["# Incident Report", f"_Generated (UTC): {generated_at}_", "", "## Summary"]
    )
    summary = rows.agg(
        F.count("*").alias("n"), F.count_if("flagged").alias("hits")
    ).selectExpr(
        "stack(2, 1, 0, 0, concat('- Records reviewed: ', n),"
        " 1, 0, 1, concat('- Flagged incidents: ', hits)) as (section, rank, part, line)"
    )
    listed = [f"- {k}: {v}" for k, v in chosen.items()] or ["- None"]
    middle = fixed_lines(2, ["", "## Filters", *listed, "", "## Risk Breakdown"])
    counts = label_counts(flagged)
    by_count = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "label")
    breakdown = counts.select(
        F.lit(3).alias("section"),
        F.row_number().over(by_count).alias("rank"),
        F.lit(0).alias("part"),
        F.concat(F.lit("- "), "label", F.lit(": "), F.col("count").cast("string")).alias("line"),
    )
    no_hits = rows.agg(F.count_if("flagged").alias("hits")).filter("hits = 0")
    no_breakdown = no_hits.selectExpr(
        "3 as section", "0 as rank", "0 as part",
        "'- No flagged records in selected scope' as line",
    )
    time_head = fixed_lines(4, ["", "## Incident Timeline"])
    time_rows = timeline(ranked, "rank").selectExpr("5 as section", "rank", "0 as part", "line")
    no_time = no_hits.selectExpr(
        "5 as section", "0 as rank", "0 as part", "'- No incidents available.' as line"
    )
    case_head = fixed_lines(6, ["", "## Detailed Flagged Cases"])
    no_cases = no_hits.selectExpr(
        "7 as section", "0 as rank", "0 as part", "'No flagged cases to report.' as line"
    )
    frames = [head, summary, middle, breakdown, no_breakdown, time_head, time_rows, no_time]
    frames += [case_head, _case_lines(ranked), no_cases]
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    return lines


def _case_lines(ranked: DataFrame) -> DataFrame:
    """The detail block of each flagged row, one array item per line."""

    def field(name: str, column) -> list:
        return [F.concat(F.lit(f"- {name}: "), column)]

    def fenced(column: str):
        return F.concat(F.lit("  ```\n"), F.coalesce(column, F.lit("")), F.lit("\n  ```"))

    reasons = F.transform("risk_explanations", lambda x: F.concat(F.lit("  - "), x))
    head = F.array(
        F.concat(F.lit("### Incident #"), F.col("id").cast("string")),
        *field("Timestamp", F.coalesce("timestamp", F.lit("None"))),
        *field("Project", filled(F.col("project_name"), "-")),
        *field("Model", filled(F.col("model_name"), "-")),
        *field("User", filled(F.col("user_id"), "-")),
        *field("Risk labels", filled(F.array_join("risk_labels", ", "), "-")),
        F.lit("- Explanations:"),
    )
    tail = F.array(
        F.lit("- Input:"),
        fenced("input_text"),
        F.lit("- Output:"),
        fenced("output_text"),
        F.lit(""),
    )
    given = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("  - None")))
    block = F.concat(head, given, tail)
    return ranked.select(
        F.lit(7).alias("section"), "rank", F.posexplode(block).alias("part", "line")
    )


def report_documents(
    df: DataFrame,
    generated_at: str,
    flagged_only: bool = True,
    limit: int = 200,
    **filters: str | None,
) -> DataFrame:
    """The JSON report as rows: one ``summary`` document and one per record."""
    chosen_rows = select_incidents(df, flagged_only, limit, **filters)
    rows = cut_lineage(late_rows(df, chosen_rows), "incidents")
    chosen = shown_filters(flagged_only, limit, filters)
    shown = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    summary = rows.agg(F.count("*").alias("count")).select(
        F.lit("summary").alias("kind"),
        F.lit(None).cast("bigint").alias("id"),
        F.to_json(
            F.struct(F.lit(generated_at).alias("generated_at"), "count", shown.alias("filters"))
        ).alias("document"),
    )
    fields = [c for c in rows.columns if c not in ("ts", "audit_date")]
    records = rows.select(
        F.lit("record").alias("kind"),
        "id",
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"),
    )
    return summary.unionByName(records)
