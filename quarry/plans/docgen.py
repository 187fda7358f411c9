"""Documents from a template and a payload: placeholders, evidence notes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

#: Fixed values.
MISSING = "（待补充）"
PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"
#: Marks of citations, which sections must not have.
CITATION = r"(?i)\bpage\s*\d+|第\s*\d+\s*页|\[\d+\]|\.pdf\b"

NOTES = "array<struct<topic:string,items:array<struct<claim:string,evidence:array<struct<source:string,page:int,excerpt:string>>>>>>"
PAYLOAD = f"title string, doc_no string, sections array<struct<key:string,text:string>>, evidence_notes {NOTES}"


def placeholders(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(PLACEHOLDER), 1))


def values(payload: Column) -> Column:
    """What placeholders stand for: title, number, and each section by its key; of a repeated key the last counts."""
    own = F.array(F.struct(F.lit("TITLE").alias("key"), payload["title"].alias("text")), F.struct(F.lit("DOC_NO").alias("key"), payload["doc_no"].alias("text")))
    pairs = F.concat(own, F.coalesce(payload["sections"], F.array().cast("array<struct<key:string,text:string>>")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["text"]))


def evidence_block(payload: Column) -> Column:
    """Topics, their claims, and where each is said."""
    def evidence(e: Column) -> Column:
        return F.concat(F.lit("    - "), e["source"], F.lit(", p. "), e["page"].cast("string"), F.lit(": "), e["excerpt"])

    def item(i: Column) -> Column:
        return F.concat_ws("\n", F.concat(F.lit("- "), i["claim"]), F.array_join(F.transform(i["evidence"], evidence), "\n"))

    notes = F.transform(payload["evidence_notes"], lambda n: F.concat_ws("\n", n["topic"], F.array_join(F.transform(n["items"], item), "\n")))
    return F.array_join(F.coalesce(notes, F.array().cast("array<string>")), "\n\n")


def render(rows: DataFrame) -> DataFrame:
    """Rows (template, payload) with text, missing and extra keys, and digests of what went in and came out: equal input, equal output."""
    filled = rows.withColumn("_values", F.map_concat(F.map_filter(values(F.col("payload")), lambda k, _: k != "EVIDENCE_NOTES"), F.create_map(F.lit("EVIDENCE_NOTES"), evidence_block(F.col("payload")))))
    named = placeholders(F.col("template"))
    # Put in from the left, one placeholder after the other: the pieces between them are kept as they are.
    pieces = F.split(F.col("template"), PLACEHOLDER, -1)
    order = F.regexp_extract_all(F.col("template"), F.lit(PLACEHOLDER), 1)
    put = F.transform(order, lambda k: F.when(F.trim(F.coalesce(F.col("_values")[k], F.lit(""))) == "", MISSING).otherwise(F.col("_values")[k]))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("a"), F.concat(put, F.array(F.lit(""))).alias("b")), lambda p: F.array(p["a"], p["b"]))), "")
    given = F.filter(F.map_keys(F.col("_values")), lambda k: ~k.isin("TITLE", "DOC_NO", "EVIDENCE_NOTES"))
    return filled.select(
        *rows.columns,
        text.alias("text"),
        F.array_sort(F.array_except(named, F.map_keys("_values"))).alias("missing"),
        F.array_sort(F.array_except(given, named)).alias("extra"),
        F.sha2(F.to_json("payload"), 256).alias("payload_sha256"),
    ).withColumn("text_sha256", F.sha2("text", 256))


def problems(payload: Column) -> Column:
    """What is wrong with a payload, as a list of words; empty if nothing is."""
    def blank(c: Column) -> Column:
        return X.clean(c) == ""

    items = F.flatten(F.transform(F.coalesce(payload["evidence_notes"], F.array().cast(NOTES)), lambda n: n["items"]))
    proofs = F.flatten(F.transform(items, lambda i: i["evidence"]))
    checks = [
        F.when(blank(payload["title"]), "empty title"),
        F.when(F.exists(payload["sections"], lambda s: blank(s["key"])), "empty section key"),
        F.when(F.exists(payload["sections"], lambda s: F.coalesce(s["text"], F.lit("")).rlike(CITATION)), "citation in a section"),
        F.when(F.exists(items, lambda i: blank(i["claim"])), "empty claim"),
        F.when(F.exists(proofs, lambda e: F.coalesce(e["page"], F.lit(0)) < 1), "page below 1"),
        F.when(F.exists(proofs, lambda e: blank(e["source"])), "empty source"),
    ]
    return F.array_compact(F.array(*checks))
