"""JSON in the answers of models: found in the text around it, and brought to one shape, without Python.

A value is a VARIANT, so a field may be a string, an object or a list, and each is asked for as what it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quoted strings whole, braces alone, and what lies between.
_TOKENS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}]|[^"{}]++|"'
_FENCED = r"(?is)```json\s*(\{.*?\})\s*```"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once however often it is used: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_object(value: Column) -> Column:
    """Whether a VARIANT is a JSON object."""
    return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), F.lit(False))


def balanced(text: Column) -> Column:
    """All parts of a text from a brace to the one that closes it, from the left: braces within quoted strings don't count."""
    spans = F.array().cast("array<struct<begin:int,length:int>>")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("begin"), spans.alias("spans"))

    def step(a: Column, token: Column) -> Column:
        opens, closes = token == "{", (token == "}") & (a["depth"] > 0)
        whole = closes & (a["depth"] == 1)
        return F.struct(
            (a["at"] + F.length(token)).alias("at"),
            F.when(opens, a["depth"] + 1).when(closes, a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
            F.when(opens & (a["depth"] == 0), a["at"]).otherwise(a["begin"]).alias("begin"),
            F.when(whole, F.concat(a["spans"], F.array(F.struct(a["begin"].alias("begin"), (a["at"] + 1 - a["begin"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        )

    found = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), start, step, lambda a: a["spans"])
    return F.transform(found, lambda s: F.substring(text, s["begin"], s["length"]))


def first_json(text: Column) -> Column:
    """The first JSON object in a text: all of it, a fenced one, or one with balanced braces; null where there is none."""

    def first(t: Column) -> Column:
        # Balanced parts alone are asked: the parser takes an object with other text behind it, too.
        return F.get(F.filter(balanced(t), lambda s: is_object(F.try_parse_json(s))), F.lit(0))

    def chosen(own: Column, inside: Column) -> Column:
        fenced = _let(F.regexp_extract(own, _FENCED, 1), lambda f: F.when(f != "", first(f)))
        return F.when(inside == own, own).otherwise(F.coalesce(fenced, inside))

    return _let(_stripped(F.coalesce(text, F.lit(""))), lambda own: _let(first(own), lambda inside: chosen(own, inside)))


def _text_of(value: Column) -> Column:
    """A string, or the JSON of anything else; nothing for null."""
    return F.when(value.isNull() | F.is_variant_null(value), F.lit("")).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")))


def items(value: Column, main: str, fields: tuple[str, ...]) -> Column:
    """A field as a list of structs of strings: one object or string is a list of itself, a string stands for `main`. Elements of other
    kinds, and those whose fields are all empty, go."""

    def listed(v: Column) -> Column:
        many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))
        return F.filter(many, lambda x: is_object(x) | F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))

    def shaped(v: Column) -> Column:
        plain = {f: F.lit("") for f in fields} | {main: _stripped(F.try_variant_get(v, "$", "string"))}
        return _let(F.try_variant_get(v, "$", "map<string,variant>"), lambda own: F.struct(*(F.when(own.isNull(), plain[f]).otherwise(_let(own[f], lambda x: _stripped(_text_of(x)))).alias(f) for f in fields)))

    def some(s: Column) -> Column:
        return F.concat(*(s[f] for f in fields)) != ""

    return F.filter(F.transform(_let(value, listed), shaped), some)


def page_payload(raw: Column, page: Column) -> Column:
    """What a page model gave, in one shape: page, text, tables, figures, notes. A list of texts is joined by lines; an answer
    without an object is its own text."""

    def joined(text: Column) -> Column:
        many = F.try_variant_get(text, "$", "array<variant>")
        return _let(many, lambda m: F.when(m.isNotNull(), F.array_join(F.transform(m, _text_of), "\n")).otherwise(_stripped(_text_of(text))))

    def shaped(found: Column, value: Column) -> Column:
        def field(name: str) -> Column:
            return F.try_variant_get(value, f"$.{name}", "variant")

        return F.struct(
            page.alias("page"),
            F.when(found.isNull(), _stripped(F.coalesce(raw, F.lit("")))).otherwise(_let(field("text"), joined)).alias("text"),
            items(field("tables"), "markdown", ("caption", "markdown")).alias("tables"),
            items(field("figures"), "description", ("caption", "description", "data_table_markdown")).alias("figures"),
            _let(field("notes"), _text_of).alias("notes"),
        )

    return _let(first_json(raw), lambda found: _let(F.try_parse_json(F.coalesce(found, F.lit("{}"))), lambda value: shaped(found, value)))
