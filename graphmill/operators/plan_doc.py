"""Model replies to plan documents, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.payload import fence_stripped

CHANGE = "struct<file_path:string,function_or_symbol:string,change_description:string,implementation_notes:string,pseudocode_sketch:string,reasoning:string,change_type:string>"
PLAN = f"struct<title:string,summary:string,services:array<struct<service:string,rationale:string,changes:array<{CHANGE}>>>,open_questions:array<string>>"
MISSING = "(not provided)"


def parse_plans(replies: DataFrame) -> DataFrame:
    """``replies(issue_id, raw)`` -> ``(issue_id, ok, plan)``; missing fields get placeholders and a note.

    A reply that is no JSON object of this form comes out with ``ok`` false and a null plan.
    """
    p = replies.withColumn("p", F.from_json(fence_stripped(F.col("raw")), PLAN, {"mode": "PERMISSIVE"}))
    is_object = F.schema_of_variant(F.try_parse_json(fence_stripped(F.col("raw")))).startswith("OBJECT")
    note = lambda f: F.when(F.col(f"p.{f}").isNull(), F.lit(f"{f} was missing from the reply"))
    notes = F.array_compact(F.array(note("title"), note("summary"), note("services")))
    plan = F.struct(
        F.coalesce("p.title", F.lit(MISSING)).alias("title"),
        F.coalesce("p.summary", F.lit(MISSING)).alias("summary"),
        F.coalesce("p.services", F.array().cast(f"array<struct<service:string,rationale:string,changes:array<{CHANGE}>>>")).alias("services"),
        F.concat(notes, F.coalesce("p.open_questions", F.array().cast("array<string>"))).alias("open_questions"),
    )
    ok = F.coalesce(is_object & F.col("p").isNotNull(), F.lit(False))
    return p.select("issue_id", ok.alias("ok"), F.when(ok, plan).alias("plan"))


def parse_summaries(raw: Column) -> Column:
    """Summary array of a reply; entries without service or text are skipped, no array gives null."""
    a = F.from_json(fence_stripped(raw), "array<struct<service:string,summary:string>>")
    return F.filter(a, lambda s: (F.coalesce(s["service"], F.lit("")) != "") & (F.coalesce(s["summary"], F.lit("")) != ""))


def files_by_type(changes: DataFrame) -> DataFrame:
    """``(service, create_files, modify_files, delete_files)``, distinct and sorted."""
    one = lambda t: F.sort_array(F.collect_set(F.when(F.col("change_type") == t, F.col("file_path")))).alias(f"{t}_files")
    return changes.groupBy("service").agg(one("create"), one("modify"), one("delete"))


def cell(text: Column) -> Column:
    """Text safe inside a Markdown table."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\|", "\\\\|"), r"\s*\n\s*", " ")


def render_markdown(plans: DataFrame) -> DataFrame:
    """``plans(issue_id, plan)`` -> ``(issue_id, text)``, sections and one table of changes per service."""

    def rows(s: Column) -> Column:
        line = lambda c: F.concat(F.lit("| "), cell(c["file_path"]), F.lit(" | "), cell(c["function_or_symbol"]), F.lit(" | "), cell(c["change_type"]), F.lit(" | "), cell(c["change_description"]), F.lit(" |"))
        return F.concat(F.lit("| File | Symbol | Change | Description |\n| --- | --- | --- | --- |\n"), F.array_join(F.transform(F.coalesce(s["changes"], F.array().cast(f"array<{CHANGE}>")), line), "\n"))

    section = lambda s: F.concat(F.lit("## "), F.coalesce(s["service"], F.lit("?")), F.lit("\n\n"), F.coalesce(s["rationale"], F.lit("")), F.lit("\n\n"), rows(s))
    questions = F.when(F.size("plan.open_questions") > 0, F.concat(F.lit("\n\n## Open questions\n\n"), F.array_join(F.transform("plan.open_questions", lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n"))).otherwise("")
    body = F.concat(F.lit("# "), F.col("plan.title"), F.lit("\n\n"), F.col("plan.summary"), F.lit("\n\n"), F.array_join(F.transform("plan.services", section), "\n\n"), questions)
    return plans.select("issue_id", body.alias("text"))


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cdata(text: Column) -> Column:
    """Character data section; its own end mark is split over two sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def column_widths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Width of each column of a text table: its header or its longest cell."""
    return rows.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(c) for c in columns])


def wrapped(text: Column, width: int = 100) -> Column:
    """Lines of at most ``width`` characters, broken at blanks and, inside long words, after slashes."""
    broken = F.regexp_replace(text, rf"([^\s]{{1,{width}}}/)(?=[^\s]{{{width},}})", "$1​")
    return F.regexp_extract_all(broken, F.lit(rf"(\S.{{0,{width - 1}}})(?:\s+|​|$)"), 1)
