"""Text expressions: normalisation, language, META headers, paths, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

META_PREFIX = "[[META"
HEADER_CAP = 120
#: Fixed ranges of Arabic letters.
ARABIC = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF]"


def normalize(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def query_language(text: Column) -> Column:
    """ar, en or auto, by the letters in it."""
    return F.when(text.rlike(ARABIC), "ar").when(text.rlike("[A-Za-z]"), "en").otherwise("auto")


def windows(text: Column, n: int) -> Column:
    """All groups of n letters of a text."""
    starts = F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: (i > 0) & (i + n - 1 <= F.length(text)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def meta_header(kind: Column, page: Column | None = None, caption: Column | None = None) -> Column:
    """First line of a chunk. Empty fields are left out, long ones cut."""

    def part(name: str, value: Column | None) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        clean = F.trim(F.translate(value.cast("string"), "\n]", " "))
        cut = F.when(F.length(clean) > HEADER_CAP, F.concat(F.left(clean, F.lit(HEADER_CAP)), F.lit("…"))).otherwise(clean)
        return F.when(value.cast("string") != "", F.concat(F.lit(f"{name}="), cut))

    fields = F.concat_ws(" ", part("type", kind), part("page", page), part("caption", caption))
    return F.concat(F.lit(META_PREFIX + " "), fields, F.lit("]]"))


def first_line(text: Column) -> Column:
    return F.trim(F.split_part(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\n"), F.lit(1)))


def meta_fields(text: Column) -> Column:
    """A map of the first line's key=value words if it is a META header, else an empty one; of a repeated key the last counts."""
    line = first_line(text)
    inside = F.trim(F.regexp_replace(F.substring(line, len(META_PREFIX) + 1, 1 << 30), r"\]+$", ""))
    tokens = F.filter(F.split(inside, r"\s+"), lambda t: F.contains(t, F.lit("=")))
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.regexp_replace(t, "^[^=]*=", "").alias("value")))
    last = F.filter(pairs, lambda p: p["key"].isNotNull())
    keys = F.array_distinct(F.transform(last, lambda p: p["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(last, lambda p: p["key"] == k), -1)["value"])
    is_header = line.startswith(META_PREFIX) & line.endswith("]]")
    return F.when(F.coalesce(is_header, F.lit(False)), F.map_from_arrays(keys, values)).otherwise(F.create_map().cast("map<string,string>"))


def meta_inside(text: Column) -> Column:
    """The fields of the first line's META header as they stand there; empty where the line is none. Plain regular expressions over
    one line, which are compiled."""
    line = F.trim(F.regexp_extract(text, r"^[^\r\n]*", 0))
    return F.regexp_extract(line, r"^\[\[META((?:[^\]]++|\](?!\]*$))*+)\]{2,}$", 1)


def field_value(inside: Column, key: str) -> Column:
    """One key of a header's fields: its last value, or null where there is no such key."""
    return F.when(inside.rlike(rf"(?:^|\s){key}="), F.regexp_extract(inside, rf"(?:^|.*\s){key}=(\S*)", 1))


def meta_value(text: Column, key: str) -> Column:
    """One key of the first line's META header: its last value, or null where the line is none or has no such key."""
    return field_value(meta_inside(text), key)


def meta_page(text: Column) -> Column:
    """The page number in the first line's META header, or null."""
    return F.regexp_extract(F.split_part(text, F.lit("\n"), F.lit(1)), r"(?i)\[\[META[^\]]*?\bpage\s*=\s*(\d+)", 1).try_cast("int")


def strip_header(text: Column) -> Column:
    """A chunk without its META line."""
    return F.when(text.startswith(META_PREFIX), F.trim(F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(F.lit("")))).otherwise(text)


def doc_folder(uri: Column, app_id: Column) -> Column:
    """The document's folder in s3://bucket/app/folder/...: behind the bucket if the application is right, else behind /app/."""
    rest = F.regexp_replace(uri, "^s3://[^/]*/", "")
    direct = F.when(uri.startswith("s3://") & (F.split_part(rest, F.lit("/"), F.lit(1)) == app_id), F.split_part(rest, F.lit("/"), F.lit(2)))
    inner = F.when(F.contains(uri, F.concat(F.lit("/"), app_id, F.lit("/"))), F.split_part(F.split_part(uri, F.concat(F.lit("/"), app_id, F.lit("/")), F.lit(2)), F.lit("/"), F.lit(1)))
    return F.coalesce(direct, inner, F.lit(""))


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def clean(column: Column) -> Column:
    return F.trim(F.coalesce(column.cast("string"), F.lit("")))


def doc_label(title: Column, doc_id: Column, uri: Column) -> Column:
    name = F.when(clean(title) == "", "(no title)").otherwise(clean(title))
    return F.concat_ws(" | ", name, F.substring(doc_id.cast("string"), 1, 8), clean(uri))


def like_pattern(term: str, escape: bool = False) -> str:
    """A substring pattern. Unescaped, % and _ in the term are wildcards."""
    if escape:
        term = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{term}%"


def cut(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


#: The long edge of a page's picture for a reader, and the zooms between which it is fitted to that.
LONG_EDGE, LEAST_ZOOM, MOST_ZOOM = 1280, 0.8, 2.0


def page_zoom(width: Column, height: Column) -> Column:
    """How far a page of some points is enlarged for a reader."""
    return F.greatest(F.lit(LEAST_ZOOM), F.least(F.lit(MOST_ZOOM), F.lit(float(LONG_EDGE)) / F.greatest(width, height, F.lit(1))))


def data_url(content: Column, kind: str = "image/png") -> Column:
    """A picture's bytes as they stand in a page."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def html_block(text: Column, right_to_left: Column) -> Column:
    """Text as an HTML block: escaped, with breaks and a direction."""
    body = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return F.concat(F.when(right_to_left, F.lit('<div dir="rtl">')).otherwise(F.lit('<div dir="ltr">')), body, F.lit("</div>"))
