"""Table blocks, packing, loose JSON and cutters that SQL calls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import chunking, page_blocks, sql_functions
from quarry.functions import loose_json as J

PAGES = [
    "| a | b |\n|---|---|\n| 1 | 2 and more |\ntext\n| second table with text |\n|  |",
    "words | with pipes | inside\nand nothing else here, at all",
    "x\n  a | --- rule of a table here\n| end |  \n",
    "no lines\n## Table (Markdown)\n what follows the mark, up to the end ",
    "## Table (Markdown)\n| a real table line comes |\n| and then another |",
    "| too short |",
    "",
    None,
    "|\n" * 30,
]
LINE = re.compile(r"^[ \t]*(\|(.*\|)?[ \t]*|.*\| ?---.*)$")


def brute_blocks(text):
    if text is None:
        return []
    runs, open_ = [], False
    for line in text.split("\n"):
        if LINE.match(line):
            runs = [*runs[:-1], [*runs[-1], line]] if open_ else [*runs, [line]]
        open_ = bool(LINE.match(line))
    blocks = ["\n".join(r).strip() for r in runs]
    if not runs and "## Table (Markdown)" in text:
        blocks = [text.split("## Table (Markdown)", 1)[1].strip()[:8000]]
    return [b for b in blocks if len(b) > 20]


def test_table_blocks(spark):
    rows = [(i, i % 2, t) for i, t in enumerate(PAGES)]
    got = page_blocks.table_blocks(spark.createDataFrame(rows, "doc long, page int, text string"), ["doc", "page"]).orderBy("doc", "block_no").collect()
    assert [(r.doc, r.block_no, r.table_text) for r in got] == [(i, n, b) for i, t in enumerate(PAGES) for n, b in enumerate(brute_blocks(t))]


def brute_pack(texts, most, separator):
    packs = []
    for t in texts:
        own = (t or "").strip()
        for at in range(0, len(own), most):
            piece = own[at : at + most]
            if packs and len(packs[-1]) + len(separator) + len(piece) <= most:
                packs[-1] += separator + piece
            else:
                packs.append(piece)
    return packs


@pytest.mark.parametrize("most", [8, 25, 1000])
def test_pack_items(spark, most):
    rng = random.Random(most)
    groups = {k: [rng.choice([None, "", " \n", "é" * rng.randint(1, 40), "a b"]) for _ in range(rng.randint(0, 9))] for k in range(12)} | {99: ["w" * 5000, "x"]}
    rows = [(k, n, t) for k, texts in groups.items() for n, t in enumerate(texts)]
    got = {}
    for r in page_blocks.pack_items(spark.createDataFrame(rows, "k long, n int, text string"), "k", ["n"], most).orderBy("k", "pack_no").collect():
        got.setdefault(r.k, []).append(r.text)
    assert got == {k: p for k, texts in groups.items() if (p := brute_pack(texts, most, "\n\n---\n\n"))}
    assert all(len(t) <= most for own in got.values() for t in own)


def test_first_json(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        ' \n{"a": {"b": "}"}} ': '{"a": {"b": "}"}}',
        'x ```JSON\n{"a": 1}\n``` y {"b": 2}': '{"a": 1}',
        'say {no} then {"a": "\\"{"} and {"c": 3}': '{"a": "\\"{"}',
        "[1, 2]": None,
        "[{\"a\": 1}]": '{"a": 1}',
        "}}{": None,
        '"open {"a": 1}': None,
        "": None,
        '{"a": "' + "x" * 50_000 + '"} tail': '{"a": "' + "x" * 50_000 + '"}',
        "{" * 2000: None,
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r.t: r.j for r in rows.select("t", J.first_json(F.col("t")).alias("j")).collect()}
    assert got == cases | {None: None}


def test_page_payload_of_odd_answers(spark):
    answers = [None, "plain ", "{}", '{"text": [1, "b", null], "tables": 5, "figures": ["", " f "], "notes": null}', '{"tables": {"caption": ["x"]}, "text": true}']
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", J.page_payload(F.col("a"), F.col("i")).alias("p"))
    got = {r.i: r.p for r in rows.collect()}
    assert [got[i].text for i in range(5)] == ["", "plain", "", "1\nb\n", "true"]
    assert [len(got[i].tables) for i in range(5)] == [0, 0, 0, 0, 1] and got[4].tables[0].caption == '["x"]'
    assert [f.description for f in got[3].figures] == ["f"] and got[3].notes == "" and got[2].page == 2


def test_cutters_in_sql(spark):
    sql_functions.register(spark)
    text = "one two three. four five\n\nsix seven eight nine ten " * 8
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = spark.sql("SELECT id, c.* FROM {rows}, LATERAL recursive_chunks(text, 40, 5) c ORDER BY id, chunk_index", rows=rows).collect()
    assert [(r.id, r.chunk_text) for r in got] == [(1, c) for c in chunking.recursive_cuts(text, 40, 5)]
    pages = spark.sql("SELECT id, p.chunk_text FROM {rows}, LATERAL text_pages(text, 50, 20) p WHERE id = 1 ORDER BY p.chunk_index", rows=rows).collect()
    assert [r.chunk_text for r in pages] == chunking.page_cuts(text, 50, 20)
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM {rows}, LATERAL recursive_chunks(text, 5, 5)", rows=rows)
