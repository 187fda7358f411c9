"""An index of names: posting lists of their letter groups, by which names that hold a term are found without reading all.

A name is in the lists of its groups of one, two and three letters, so that a term of any length is looked up alike. Lists are
sorted arrays of name ids, those of common groups cut into blocks. A lookup takes a term's rarest groups by their document
frequencies, intersects their lists, and compares the names that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import windows

#: Ids in one row of a posting list, about.
BLOCK = 4096
#: Lists that a term's lookup intersects at most, and how much longer than the shortest one they may be.
LISTS, LONGER = 3, 16


@dataclass
class NameIndex:
    """names: (id, name), lower-case and distinct. postings: (gram, block, ids). sizes: (gram, names), the document frequencies."""

    names: DataFrame
    postings: DataFrame
    sizes: DataFrame

    def write(self, folder: str) -> NameIndex:
        """Store the index, lists by gram, so that a lookup's filter on grams reads few row groups."""
        self.names.write.mode("overwrite").parquet(f"{folder}/names")
        self.sizes.write.mode("overwrite").parquet(f"{folder}/sizes")
        self.postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{folder}/postings")
        return NameIndex.read(self.names.sparkSession, folder)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> NameIndex:
        return cls(*(spark.read.parquet(f"{folder}/{part}") for part in ("names", "postings", "sizes")))


def build(rows: DataFrame, name_col: str = "name") -> NameIndex:
    """The index of the distinct names of some rows; a null name has none. The empty group holds all names, for terms of
    wildcards alone."""
    names = rows.select(F.lower(F.col(f"`{name_col}`")).alias("name")).where("name is not null").distinct().select(F.xxhash64("name").alias("id"), "name")
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *(windows(F.col("name"), n) for n in (1, 2, 3))))
    each = names.select("id", F.explode(grams).alias("gram"))
    sizes = each.groupBy("gram").agg(F.count("*").alias("names"))
    blocks = F.ceil(F.col("names") / BLOCK)
    placed = each.join(sizes, "gram").select("gram", F.pmod("id", blocks).alias("block"), "id")
    postings = placed.groupBy("gram", "block").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return NameIndex(names, postings, sizes)


def _grams_of(term: Column) -> Column:
    """What a name that holds the term has in any case: the groups of three letters of its literal runs, and shorter runs themselves."""
    runs = F.filter(F.split(term, "[%_]+"), lambda r: r != "")
    groups = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 3, F.array(r)).otherwise(windows(r, 3))))
    return F.when(F.size(runs) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(groups))


def candidates(index: NameIndex, terms: DataFrame) -> DataFrame:
    """(term, id) of the names that are in the lists of a term's rarest groups. terms: (term), lower-case."""
    asked = terms.select("term").distinct().withColumn("grams", _grams_of(F.col("term")))
    known = asked.select("term", F.size("grams").alias("all"), F.explode("grams").alias("gram")).join(index.sizes, "gram")
    whole = Window.partitionBy("term")
    # A term with a group that no name has is in no name.
    known = known.withColumns({"found": F.count("*").over(whole), "fewest": F.min("names").over(whole), "n": F.row_number().over(whole.orderBy("names", "gram"))}).where("found = all")
    chosen = known.where((F.col("n") <= LISTS) & (F.col("names") <= F.col("fewest") * LONGER))
    chosen = chosen.select("term", "gram", F.count("*").over(whole).alias("lists"))
    met = index.postings.join(chosen, "gram").select("term", "lists", F.explode("ids").alias("id"))
    return met.groupBy("term", "lists", "id").agg(F.count("*").alias("n")).where("n = lists").select("term", "id")


def lookup(index: NameIndex, terms: DataFrame) -> DataFrame:
    """(term, name): the distinct lower-case names that hold each distinct term, as ILIKE '%term%' has it, % and _ being wildcards. A
    backslash is a letter, a null term is none, and the empty term is in all names."""
    asked = terms.select(F.lower("term").alias("term")).where("term is not null").distinct()
    pattern = F.concat(F.lit("%"), F.replace("term", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return candidates(index, asked).join(index.names, "id").where(F.like("name", pattern)).select("term", "name")
