"""Text files as page rows, artefacts by key, and the answers of page-reading services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import chunking as C

#: Fixed value: the mark that a UTF-8 file may begin with.
BOM = "EFBBBF"


def decoded(content: Column) -> Column:
    """The text of a file's bytes: UTF-8 with or without its mark, else Latin-1; line ends as \\n. A null is none."""
    marked = F.hex(F.substring(content, 1, 3)) == BOM
    plain = F.when(marked, F.substring(content, F.lit(4), F.length(content))).otherwise(content).cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\\r\\n?", "\n")


def text_pages(files: DataFrame, key: list[str], content_col: str = "content", size: int = C.PAGE_CHARS) -> DataFrame:
    """(key, page_no, text) of files' bytes: pages that end at line breaks where there are some. An empty file is one empty page."""
    cut = files.select(*key, F.posexplode(C.paginate(size)(decoded(F.col(content_col)))).alias("n", "text"))
    return cut.select(*key, (F.col("n") + 1).alias("page_no"), "text")


def read_pages(spark: SparkSession, path: str, glob: str = "*", size: int = C.PAGE_CHARS) -> DataFrame:
    """Page rows (doc_key, path, page_no, text, tables, figures, png_bytes, error) of all text files below a path. A file of another
    kind has one row with page 0 that says so, one of no bytes has none, as Spark leaves it out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.select(F.substring_index("path", "/", -1).alias("doc_key"), "path", "content").withColumn("kind", F.lower(F.regexp_extract("doc_key", r"\.([^.]*)$", 1)))
    none = {"tables": F.lit(""), "figures": F.lit(""), "png_bytes": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")}
    pages = text_pages(files.where("kind = 'txt'"), ["doc_key", "path"], size=size).withColumns(none)
    unknown = F.concat(F.lit("unknown format: "), F.when(F.col("kind") == "", "none").otherwise(F.col("kind")))
    others = files.where("kind <> 'txt'").withColumns({"page_no": F.lit(0), "text": F.lit(None).cast("string")} | none | {"error": unknown})
    return pages.unionByName(others.select(pages.columns))


# Artefacts by key

#: The folders of a document and the file ends of its pages.
KINDS = {"image": ("ocr/img", "png"), "text": ("ocr/text", "txt"), "table": ("ocr/tab", "txt"), "figure": ("ocr/figure", "txt")}


def artefact_key(app: Column, folder: Column, kind: str, page: Column, translated: bool = False) -> Column:
    place, end = KINDS[kind]
    if translated:
        place = {"ocr/text": "ocr/text_trans", "ocr/tab": "ocr/table_trans", "ocr/figure": "ocr/figure_trans"}[place]
    return F.concat(app, F.lit("/"), folder, F.lit(f"/{place}/"), folder, F.lit("_page"), page.cast("string"), F.lit(f".{end}"))


def artefacts(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(app_id, folder, page_no, content) of stored texts of one kind, their keys taken apart. content is read whole."""
    place = KINDS[kind][0]
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(f"{root}/*/*/{place}").select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    pattern = rf"([^/]+)/([^/]+)/{place}/[^/]*_page(\d+)\.[a-z]+$"
    parts = [F.regexp_extract("path", pattern, i) for i in (1, 2, 3)]
    return rows.select(parts[0].alias("app_id"), parts[1].alias("folder"), parts[2].try_cast("int").alias("page_no"), "content")


def page_numbers(rows: DataFrame) -> DataFrame:
    return rows.select("app_id", "folder", "page_no").where("page_no is not null").distinct()


def page_assets(pages: DataFrame, **kinds: DataFrame) -> DataFrame:
    """Pages (app_id, folder, page_no) with the contents of each kind; what is missing is empty."""
    key = ["app_id", "folder", "page_no"]
    for name, rows in kinds.items():
        pages = pages.join(rows.select(*key, F.col("content").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return pages


# Responses of a page-reading service

OCR_RESPONSE = "struct<text:string,tables:array<struct<neighbor_texts:array<string>,markdown:string,html:string>>>"
#: Names of languages that services know under another one.
OCR_LANGUAGES = {"zh": "ch", "cn": "ch", "chinese": "ch", "english": "en", "arabic": "ar"}


def ocr_blocks(response: Column, most: int = 3) -> Column:
    """The tables of a service's JSON answer as numbered markdown blocks."""
    found = F.slice(F.coalesce(F.from_json(response, OCR_RESPONSE)["tables"], F.from_json(F.lit("[]"), "array<struct<neighbor_texts:array<string>,markdown:string,html:string>>")), 1, most)
    blocks = F.transform(found, lambda t, i: F.concat(F.lit("## Table (Markdown) "), (i + 1).cast("string"), F.lit("\n"), F.coalesce(t["markdown"], F.lit(""))))
    return F.array_join(blocks, "\n\n")


def ocr_language(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in OCR_LANGUAGES.items() for x in pair))
    low = F.lower(F.trim(name))
    return F.coalesce(table[low], low)
