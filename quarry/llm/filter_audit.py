"""How filters interact: what each of them removes at each place of every order.

A document's failures are one mask, a bit for each filter. Documents shrink to cells (part, mask) with counts before
anything is multiplied; a cell is unpivoted against the steps of all orders, a running bit-or over the steps before says
what an earlier filter has removed, and conditional sums and totals over a filter's rows give the figures.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders of more filters than this are too many to list.
MOST_FILTERS = 7
WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null: few words, repeated words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _mask(conditions: dict[str, Column], first_bit: int = 0) -> Column:
    bits = [F.when(c, F.lit(1 << (first_bit + i))).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())]
    total = F.lit(0)
    for b in bits:
        total = total.bitwiseOR(b)
    return total


def cells(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, and those of them with a label quality or toxic of 1.

    The last bit is that of copies: a text that a smaller id has, too. conditions: by name, over the column `text` (a null
    text is empty). Repeated rows count each; rows with one id don't make each other copies. A null id is no copy and has
    none; a null part is the empty string. An id with several labels has those of any of them.
    """
    conditions = text_filters(F.col("text")) if conditions is None else conditions
    copy = 1 << len(conditions)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), _mask(conditions).alias("mask"))
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(flags, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # Copies of one text come down to as many rows as they have parts and labels, whatever their number.
    same = ["digest", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*same).agg(
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    own = F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.col("first")).otherwise(0)
    by_text = by_text.withColumn("own", own + F.col("unnamed"))
    kinds = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    split = by_text.select("part", "good", "toxic", kinds.alias("kind")).select("part", "good", "toxic", "kind.*").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(masks: DataFrame, names: str) -> DataFrame:
    """One row per part, order and step of cells (part, mask, n, good, toxic); names: a letter for each bit, the lowest first.

    kept: left after the step; removed: by the step; redundant: fail it, but went before; unique_fails: fail it alone;
    good_lost and toxic_lost: of those it removes; shapley: what its filter removes, over all orders. A part without documents
    has no rows; no part has fewer than all orders.
    """
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"not from one to {MOST_FILTERS} different letters: {names!r}")
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    steps = masks.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    steps = steps.withColumn("letter", letter).withColumn("bit", F.element_at(F.create_map(*(x for i, name in enumerate(names) for x in (F.lit(name), F.lit(1 << i)))), F.col("letter")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(before), F.lit(0))
    steps = steps.withColumns({"fails": F.col("mask").bitwiseAND(F.col("bit")) != 0, "gone": earlier != 0})

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")

    fails, gone = F.col("fails"), F.col("gone")
    sums = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return sums.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)
