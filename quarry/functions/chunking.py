"""Cutting texts into chunks and pages."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate, chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

#: Separators in the order they are tried.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "؛", ";", " ", ""]
CHUNK_SIZE, OVERLAP = 4000, 200
BLOCK_CAP = 20000
PAGE_CHARS, PAGE_SEARCH = 5000, 3000


def sliding_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters, `overlap` of them shared with the one before: an array, empty for an empty text.

    The number of windows has a closed form, so the text is cut without a loop.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    stride = size - overlap
    n = F.length(text)
    windows = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - overlap) / F.lit(stride))).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.substring(text, i * stride + 1, F.lit(size)))
    return F.when(n > 0, cuts).otherwise(F.array().cast("array<string>"))


def _groups(lengths: Iterable[int], size: int) -> list[int]:
    """A group number for each piece: a piece is in the group of the one before it while they fit together."""

    def place(group: tuple[int, int], length: int) -> tuple[int, int]:
        number, filled = group
        return (number, filled + length) if filled + length <= size else (number + 1, length)

    return [number for number, _ in accumulate(lengths, place, initial=(0, 0))][1:]


def _pieces(text: str, separator: str, size: int) -> list[str]:
    """A text in pieces that each end with the separator; without one, in pieces of `size` characters."""
    if not separator:
        return [text[at : at + size] for at in range(0, len(text), size)]
    parts = [part + separator for part in text.split(separator) if part]
    numbered = zip(_groups(map(len, parts), size), parts, strict=True)
    joined = ("".join(part for _, part in own) for _, own in groupby(numbered, key=lambda pair: pair[0]))
    return [piece for piece in joined if piece.strip()]


def recursive_cuts(text: str | None, size: int, overlap: int) -> list[str]:
    """Cut at the coarsest separator that makes pieces fit, then put the end of each chunk before the next one."""
    pieces = [text or ""]
    for separator in SEPARATORS:
        kept = filter(None, map(str.strip, pieces))
        pieces = list(chain.from_iterable([t] if len(t) <= size else _pieces(t, separator, size) for t in kept))

    def lead(before: str, piece: str) -> str:
        return (before[-overlap:] + piece).strip()

    chunks = accumulate(pieces, lead) if overlap > 0 else pieces
    return [c for c in map(str.strip, chunks) if c]


def recursive_chunks(size: int = CHUNK_SIZE, overlap: int = OVERLAP):
    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_cuts(t, size, overlap))

    return chunks


def chunk_text(text: Column, method: str = "recursive", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    return recursive_chunks(size, overlap)(text) if method == "recursive" else sliding_chunks(text, size, overlap)


def page_cuts(text: str | None, size: int = PAGE_CHARS, search: int = PAGE_SEARCH) -> list[str]:
    """Pages of `size` characters, each drawn out to the last line break of the next `search` ones. An empty text is one empty page."""
    text = (text or "").strip()
    if size <= 0 or len(text) <= size:
        return [text]
    pages, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            line = text.rfind("\n", end, end + search)
            end = line if line > at else end
        pages.append(text[at:end].strip())
        at = end
    return pages


def paginate(size: int = PAGE_CHARS, search: int = PAGE_SEARCH):
    @F.pandas_udf("array<string>")
    def pages(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: page_cuts(t, size, search))

    return pages


def closed_pages(text: Column, size: int = PAGE_CHARS) -> Column:
    """Pages of `size` characters exactly, as an array; at least one."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(size))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def pages_to_chunks(pages: DataFrame, key: str = "doc_id", method: str = "sliding", size: int = CHUNK_SIZE, overlap: int = OVERLAP, cap: int = BLOCK_CAP) -> DataFrame:
    """(key, chunk_index, chunk_text, block_type, page_no): all text chunks of a document by page, then its tables, then its
    figures, each under a META header. Tables and figures stay whole up to `cap` characters."""

    def trimmed(name: str) -> Column:
        return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"^\s+|\s+$", "")

    def block(order: int, kind: str, part: Column, body: Column) -> Column:
        return F.struct(F.lit(order).alias("block"), F.lit(kind).alias("block_type"), part.alias("part"), body.alias("body"))

    texts = F.transform(chunk_text(trimmed("text"), method, size, overlap), lambda body, part: block(0, "text", part, body))
    others = F.array(*(block(n, kind, F.lit(0), X.cut(trimmed(name), cap, "\n...(truncated)")) for n, (name, kind) in enumerate((("tables", "Tables"), ("figures", "Figures")), 1)))
    rows = pages.select(key, "page_no", F.inline(F.concat(texts, others)))
    order = Window.partitionBy(key).orderBy("block", "page_no", "part")
    header = X.meta_header(F.col("block_type"), F.col("page_no"))
    return rows.where("body <> ''").select(
        key, (F.row_number().over(order) - 1).alias("chunk_index"), F.concat(header, F.lit("\n"), F.col("body")).alias("chunk_text"), "block_type", "page_no"
    )


def captioned_chunks(blocks: DataFrame, key: str = "doc_id", size: int = CHUNK_SIZE, overlap: int = OVERLAP, cap: int = BLOCK_CAP) -> DataFrame:
    """(key, chunk_index, chunk_text, block_type, page_no) of blocks (key, page_no, block_no, block_type, caption, text), in their order:
    the older form, in which a table or figure keeps its caption in its header. Text is cut, anything else stays whole up to
    `cap` characters; a text block has no caption."""
    kind = F.lower(F.coalesce("block_type", F.lit("text")))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    parts = F.when(kind == "text", sliding_chunks(body, size, overlap)).otherwise(F.array(X.cut(body, cap, "\n...(truncated)")))
    cut = blocks.select(key, "page_no", "block_no", kind.alias("block_type"), F.when(kind == "text", "").otherwise(F.coalesce("caption", F.lit(""))).alias("caption"), F.posexplode(parts).alias("part", "body"))
    order = Window.partitionBy(key).orderBy("page_no", "block_no", "part")
    header = X.meta_header(F.col("block_type"), F.col("page_no"), F.col("caption"))
    return cut.where("body <> ''").select(key, (F.row_number().over(order) - 1).alias("chunk_index"), F.concat(header, F.lit("\n"), F.col("body")).alias("chunk_text"), "block_type", "page_no")


def full_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's pages with something in them, in order, each under its number."""
    some = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: F.concat(F.lit("[page "), p["page_no"].cast("string"), F.lit("]\n"), p["text"]))
    return some.groupBy(key).agg(F.array_join(lines, "\n\n").alias("full_text"))
