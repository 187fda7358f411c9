"""The corpus pipeline as a whole, and its stages one by one, against plain Python."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_kernels import brute_hits
from test_llm_operators import brute_repeats, cut
from tokenizers import Tokenizer

from quarry.llm import language_id, simhash
from quarry.llm.queries import held_out
from quarry.llm.runtime import Workspace, dropped_behind, shared_folder
from quarry.llm.tokenizing import byte_bpe_path

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Two languages and one that nobody labels, copies, near copies, repeated passages, benchmark items, nulls and repeated rows."""
    rng = random.Random(21)
    parts = {"aa": ["la", "mi", "so", "ter"], "bb": ["kk", "tz", "gr\u00fc", "ow"], "zz": ["\u0436\u0438", "\u0448\u043e", "\u0440\u0430"]}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(2, 5))) for _ in range(n))
    items = [say("aa", 30), say("bb", 16), say("aa", 5), None]
    shared = say("aa", 45)
    texts = [(say(k, rng.randint(40, 160)), k) for k in ["aa", "bb"] * 30]
    base = say("aa", 200)
    texts += [(base, "aa"), (base, "aa"), (base.replace("la", "LA", 1), None), (f"{say('aa', 60)} {shared} {say('aa', 10)}", "aa"), (f"{shared}\n{say('aa', 70)}", "aa"), (shared, "aa")]
    texts += [(f"{say('aa', 20)} {items[0]} {say('aa', 20)}", "aa"), (f"{say('bb', 900)} {items[1]}", "bb"), (say("zz", 80), None), (say("zz", 90), None), (None, "aa"), ("", "bb"), (" 12 .", None)]
    rows = [(i, t, k, f"s{i % 3}", len(t or "")) for i, (t, k) in enumerate(texts)]
    rows += [rows[3], rows[3], (None, rows[5][1], "aa", None, 0), (None, say("bb", 70), "bb", None, 0), (None, None, None, None, None)]
    return rows, items


def brute_language(rows, spark):
    """Rows that the models, fitted as the stage does, don't reject, each text judged by itself."""
    df = spark.createDataFrame(rows, KIND)
    models = language_id.train(df.where(~held_out(F.col("doc_id"))))
    index = models.index()
    return [r for r in rows if not models.predict([r[1] or ""], index)[3][0]]


def brute_near(rows):
    prints = [int(simhash.fingerprints_of([r[1]])[0]) for r in rows]
    left, out = set(range(len(rows))), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += [j for j in left if (prints[i] ^ prints[j]).bit_count() <= 2]
        left -= group
        out.append(sorted(((rows[i][0] is None, rows[i][0] or 0), rows[i]) for i in group)[0][1])
    return out


def brute_substring(rows):
    """Null ids neither repeat others nor are repeated, but for what comes twice in their own text."""
    kept = dict(brute_repeats([(r[0], r[1]) for r in rows if r[0] is not None]))
    out = []
    for r in rows:
        text = kept[r[0]] if r[0] is not None else brute_repeats([(0, r[1])])[0][1]
        if text.split(" ") == cut(r[1]) or not cut(r[1]):
            text = r[1]
        elif not text:
            continue
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return out


def brute_clean(rows, items):
    return [r for r, (hit, _) in zip(rows, brute_hits([r[1] for r in rows], items), strict=True) if not (any(hit) and 20 * sum(hit) >= len(hit))]


def brute_pieces(rows):
    t, out = Tokenizer.from_file(byte_bpe_path()), []
    for doc_id, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        while at < len(ids):
            n = min(1024, 1 << (len(ids) - at).bit_length() - 1)
            out.append((doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_every_stage_and_the_whole(spark, folder):
    rows, items = corpus()
    steps = [lambda r: brute_language(r, spark), brute_near, brute_substring, lambda r: brute_clean(r, items)]
    docs = spark.createDataFrame(rows, KIND)
    sizes = [len(rows)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, steps, strict=False):
        rows = brute(rows)
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert ordered(out.collect()) == ordered(rows), name
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, KIND)
    assert all(a > b for a, b in zip(sizes[:2], sizes[1:3], strict=True)) and sizes[4] < sizes[3]  # the third one mostly shortens
    got = corpus_pipeline.run(spark, folder)
    assert ordered(got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) == ordered(brute_pieces(rows))
    assert sorted(r.sequence_id for r in got.collect()) == list(range(got.count()))


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workspaces_are_dropped(spark):
    with dropped_behind():
        kept = Workspace(spark, "dropped")
        kept.table(spark.range(3), "t")
        place = kept.root.removeprefix("file://").removeprefix("file:")
        assert list(__import__("pathlib").Path(place).iterdir())
    assert not __import__("pathlib").Path(place).exists()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session())
