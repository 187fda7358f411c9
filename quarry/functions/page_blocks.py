"""Blocks of page texts as relations: the tables that stand in them, and items packed to a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What follows the mark is cut at a length, and blocks of a few characters don't count.
TAIL_MARK, TAIL_CAP, LEAST_TABLE = "## Table (Markdown)", 8000, 20
#: Fixed value: what stands between packed items.
SEPARATOR = "\n\n---\n\n"
#: A line of a table: pipes at both ends, or a rule of dashes behind a pipe.
TABLE_LINE = r"^[ \t]*(\|(.*\|)?[ \t]*|.*\| ?---.*)$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def table_blocks(pages: DataFrame, key: list[str], text_col: str = "text", *, mark: str = TAIL_MARK, least: int = LEAST_TABLE) -> DataFrame:
    """(key, block_no, table_text) of the tables in the texts of pages: runs of table lines, numbered from 0 in each page.

    Lines are rows, and a run is an island among them: its lines have the same difference between their number and their rank
    among the page's table lines. A page without such a line gives what follows the mark, where there is one. Pages are told
    apart by their key; a null text has none.
    """
    lines = pages.where(F.col(text_col).isNotNull()).select(*key, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line")).where(F.col("line").rlike(TABLE_LINE))
    island = F.col("at") - F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    runs = lines.withColumn("island", island).groupBy(*key, "island").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    runs = runs.select(*key, "at", stripped(F.array_join(F.col("lines.line"), "\n")).alias("table_text"))
    marked = pages.where(F.contains(F.col(text_col), F.lit(mark))).join(lines.select(*key).distinct(), key, "left_anti")
    tail = F.substring(F.col(text_col), F.locate(mark, F.col(text_col)) + len(mark), F.length(text_col))
    tails = marked.select(*key, F.lit(0).alias("at"), F.left(stripped(tail), F.lit(TAIL_CAP)).alias("table_text"))
    some = runs.unionByName(tails).where(F.length("table_text") > least)
    return some.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("at")) - 1).alias("block_no"), "table_text")


def pieces(text: Column, most: int) -> Column:
    """A text without the white space around it in pieces of at most `most` characters: an array, empty where nothing is left."""
    own = stripped(F.coalesce(text, F.lit("")))
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(own)), lambda i: (i % most == 0) & (i < F.length(own))), lambda i: F.substring(own, i + 1, F.lit(most)))


def packed(items: Column, most: int, separator: str = SEPARATOR) -> Column:
    """An array of texts, none longer than `most` characters, that hold all items of an array in their order.

    A fold: an item joins the last text if both fit with the separator, else it begins one.
    """
    begin = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(0).alias("room"))

    def step(a: Column, item: Column) -> Column:
        need = F.length(item) + len(separator)
        fits = (F.size(a["texts"]) > 0) & (need <= a["room"])
        last = F.concat(F.element_at(a["texts"], -1), F.lit(separator), item)
        texts = F.when(fits, F.concat(F.slice(a["texts"], F.lit(1), F.size(a["texts"]) - 1), F.array(last))).otherwise(F.concat(a["texts"], F.array(item)))
        return F.struct(texts.alias("texts"), F.when(fits, a["room"] - need).otherwise(most - F.length(item)).alias("room"))

    return F.aggregate(items, begin, step, lambda a: a["texts"])


def pack_items(rows: DataFrame, key: str, order: list[str], most: int, text_col: str = "text", separator: str = SEPARATOR) -> DataFrame:
    """(key, pack_no, text): the items of each key in the order of some columns, packed. An item that alone is longer is spread
    over several texts; nothing is cut off. Empty items go. A key's items are one row, as a document's or conversation's are."""
    if most <= len(separator):
        raise ValueError("a pack must hold more than its separator")
    cut = rows.select(key, F.struct(*order, F.col(text_col).alias("_text")).alias("item"))
    own = cut.groupBy(key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    parts = F.flatten(F.transform("items", lambda i: pieces(i["_text"], most)))
    return own.select(key, F.posexplode(packed(parts, most, separator)).alias("pack_no", "text"))


def sections(pages: DataFrame, key: list[str], tags: dict[str, str], text_col: str = "text") -> DataFrame:
    """(key, kind, text) of the blocks that tags open in page texts; tags: the tag of each kind.

    A tag opens a block that ends at the next one. What stands before the first is of kind `text`; blocks of one kind are joined
    by a blank line, in their order, and empty ones go. A page without a tag is text as a whole.
    """
    marks = "|".join(rf"\Q{tag}\E" for tag in sorted(tags.values(), key=len, reverse=True))
    parts = pages.select(*key, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), rf"(?={marks})", -1)).alias("at", "part"))
    kind, body = F.lit("text"), F.col("part")
    for own, tag in sorted(tags.items(), key=lambda item: len(item[1])):
        opens = F.startswith(F.col("part"), F.lit(tag))
        kind, body = F.when(opens, own).otherwise(kind), F.when(opens, F.substring(F.col("part"), F.lit(len(tag) + 1), F.length("part"))).otherwise(body)
    blocks = parts.select(*key, "at", kind.alias("kind"), stripped(body).alias("body")).where("body <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n\n")
    return blocks.groupBy(*key, "kind").agg(joined.alias("text"))
