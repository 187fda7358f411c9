import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, hnsw, language_id, packing, sharding, simhash, substring_dedup, suffix_dedup, token_output, words
from quarry.llm.components import components
from quarry.llm.queries import QUERIES
from quarry.llm.runtime import Workspace
from quarry.llm.tokenizing import byte_bpe_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, m string, h string, spans string, rest string, kept string"


def corpus():
    """Copies, near copies, shared passages, repeated lines, nulls, empty and long texts."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "ans"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    shared, line = say(60), say(25)
    base = say(300)
    texts = [base, base, base.replace("ka", "KA", 1), say(100), f"{say(30)} {shared} {say(40)}", f"{say(10)}\n{shared}\t{say(5)}", "be " * 70, None, "", " \n", say(5)]
    texts += [f"{say(20)} {line} {say(9)} {line}", say(2000) + " " + shared, "é" * 300, shared, line, base + " end"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx" if i % 2 else "yy", "s", 0, 1, "m", "h", "s", "r", "k") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, and ids that are null."""
    rows = [(i, t, None, None, None, None, None, None, None, None, None) for i, t in [*corpus()[:4], *corpus()[:2], (None, corpus()[0][1]), (None, None)]]
    return spark.createDataFrame(rows, SCHEMA)


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substring_dedup(docs):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    seen = set()
    for i, t in corpus():
        w = cut(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    kept = {r.doc_id: r.text for r in substring_dedup.deduplicate(docs).collect()}
    assert 1 not in kept and kept[7] is None and kept[9] == " \n" and kept[0] == corpus()[0][1]


def brute_repeats(rows, size=20):
    """Words that are left, by sets of windows: those of smaller ids, and earlier ones of the document."""
    seen, out = set(), []
    for i, t in sorted(rows):
        w = cut(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if tuple(w[s : s + size]) in seen:
                gone[s : s + size] = [True] * size
            seen.add(tuple(w[s : s + size]))
        out.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_of_a_branching_graph(spark, seed):
    """Documents that are put together from a few passages and cut anywhere, with loops and copies: few minimisers, many branches."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 90))] for _ in range(10)]
    rows = []
    for i in range(60):
        w = [x for _ in range(rng.randint(1, 4)) for x in rng.choice(passages)]
        a = rng.randrange(max(1, len(w) // 2))
        rows.append((i, " ".join(w[a:])))
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in substring_dedup.remove_repeats(df).collect()) == brute_repeats(rows)


def test_compaction_stops_at_branches(spark):
    """Four pieces in a row at one source; the third begins at a node that another piece leads to, too, and the last is rarer."""
    rows = [(1, 1, 0, 0, 5, 3, 100, 101), (2, 2, 0, 5, 4, 3, 101, 102), (3, 3, 0, 9, 6, 3, 102, 103), (4, 4, 0, 15, 2, 2, 103, 104), (5, 5, 7, 30, 3, 2, 200, 102), (6, 6, 9, 1, 3, 1, 101, 300)]
    pieces = spark.createDataFrame(rows, "m long, h long, source long, source_start int, n int, times long, enters long, leaves long")
    assert {r.m: r["head"] for r in substring_dedup.compacted(pieces).collect()} == {1: 0, 2: 0, 3: 9, 4: 15, 5: 30, 6: None}


def test_spans_are_verified_by_their_words():
    """Digests are those of the words, wherever they stand."""
    grid = words.words(np.frombuffer(b"a b c d a b x d", np.uint8), np.array([0, 15]), words.SPACE)
    one, two, three = substring_dedup._digests(grid, np.array([0, 4, 4]), np.array([2, 6, 7])).to_pylist()
    assert one == two != three and len(one) == 16


def test_substring_dedup_of_odd_rows(odd):
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.n_removed for r in rows if r.doc_id == 0) == 0  # rows of one id don't repeat each other
    assert [r.n_removed for r in rows if r.doc_id is None] == [0, 0]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, hot):
    counts = {}
    for i, t in corpus():
        w = cut(t)
        for s in range(len(w) - 49):
            counts.setdefault(tuple(w[s : s + 50]), []).append((i, s))
    want, with_whom = {}, {}
    for places in counts.values():
        for i, s in places if len(places) > 1 else []:
            want.setdefault(i, set()).update(range(s, s + 50))
            with_whom.setdefault(i, set()).update(j for j, _ in places)
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs, hot=hot).collect()}
    assert {i: set().union(*(range(a, b) for a, b in r.spans)) for i, r in got.items()} == want
    assert all(set(r.others) <= with_whom[i] and r.others for i, r in got.items())
    left = {r.doc_id: " ".join(cut(r.text)) for r in suffix_dedup.deduplicate(docs, hot=hot).select("doc_id", "text").collect()}
    want = dict(brute_repeats(corpus(), 50))
    words_ = {i: len(cut(t)) for i, t in corpus()}
    assert left == {i: t for i, t in want.items() if t or not words_[i]}


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup_of_hot_passages(spark, hot):
    """A passage that most documents share, with other words around it, and copies: no place is lost whichever way keys go."""
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    common, copy = say(70), say(130)
    rows = [(i, " ".join(say(rng.randint(0, 30)) + common[rng.randint(0, 9) :] + say(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100 + i, " ".join(copy)) for i in range(20)] + [(200, " ".join(say(30) + common + say(5) + common))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    counts = {}
    for i, t in rows:
        w = cut(t)
        for s in range(len(w) - 49):
            counts.setdefault(tuple(w[s : s + 50]), []).append((i, s))
    want = {}
    for places in counts.values():
        for i, s in places if len(places) > 1 else []:
            want.setdefault(i, set()).update(range(s, s + 50))
    got = {r.doc_id: set().union(*(range(a, b) for a, b in r.spans)) for r in suffix_dedup.repeated_passages(df, hot=hot).collect()}
    assert got == want
    left = sorted((r.doc_id, " ".join(cut(r.text))) for r in suffix_dedup.deduplicate(df, hot=hot).collect())
    assert left == [x for x in brute_repeats(rows, 50) if x[1]]


def test_suffix_dedup_of_odd_rows(odd):
    """Rows with one id are one document: a copy under the same id is no repeat; null ids and texts take no part."""
    got = {r.doc_id for r in suffix_dedup.repeated_passages(odd).collect()}
    assert got == {0, 1, 2}  # they share passages with each other
    assert suffix_dedup.deduplicate(odd).columns == odd.columns


def test_suffix_dedup_with_parts_of_the_passage_in_between(spark):
    """Quotes of a passage's end and of its beginning lie between two copies in any order of the suffixes."""
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = say(50)
    text = " ".join(shared).encode()
    grid = words.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words.SPACE)
    at = int(suffix_dedup._least_places(words.Rolling(grid.hashes()).windows(8), 43)[0])
    assert 0 < at < 42
    texts = [say(30) + shared + say(30) for _ in range(2)]
    texts += [say(30) + shared[max(0, at - 1) :] + say(30) for _ in range(200)] + [say(30) + shared[: at + 8] + say(30) for _ in range(200)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.spans], r.others) for r in suffix_dedup.repeated_passages(rows).collect()}
    assert got == {0: ([(30, 80)], [1]), 1: ([(30, 80)], [0])}


def test_simhash(docs, spark):
    got = {r.doc_id: (r.bits & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: int(simhash.fingerprints_of([t])[0]) for i, t in corpus()}
    parent = {i: i for i in prints}
    def root(i):
        return i if parent[i] == i else root(parent[i])
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {i: (prints[i], root(i)) for i in prints}
    assert simhash.deduplicate(docs).columns == docs.columns


def test_simhash_of_odd_rows(odd):
    """Rows stay apart; null ids count in no minimum; of each group one row stays, one without an id only where none has one."""
    rows = simhash.near_duplicates(odd).collect()
    prints = {i: int(simhash.fingerprints_of([t])[0]) for i, t in corpus()[:4]}
    assert prints[0] == prints[1] and len(rows) == odd.count()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(False, 0, 0), (False, 0, 0), (False, 1, 0), (False, 1, 0), (False, 2, 0), (False, 3, 3)]
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["0", "None"]
    left = [(r.doc_id, r.text) for r in simhash.deduplicate(odd).collect()]
    assert sorted(left, key=str) == sorted([(0, corpus()[0][1]), (3, corpus()[3][1]), (None, None)], key=str)


def test_simhash_links_chains(spark):
    values = [0b0, 0b11, 0b1111, 0b1111 << 20, 0b111 << 20, 1 << 40]
    rows = spark.createDataFrame([(v,) for v in values], "bits long")
    got = {tuple(r) for r in simhash.links(rows).select("a", "b").collect()}
    near = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    assert got <= near
    nodes = {r.node: r.component for r in components(rows.sparkSession.createDataFrame(list(got), "a long, b long"), Workspace(spark, "t")).collect()}
    assert nodes[0b1111] == 0 and nodes[0b1111 << 20] == 0b111 << 20


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert set(got.values()) == {1, 100} and got[160] == 100 and len(got) == 61 + 49


def test_language_id_learns_every_language(spark):
    """Languages whose text lies in two long documents, and languages with one text, alone or repeated."""
    rng = random.Random(3)
    say = lambda k, n: " ".join("".join(rng.choice(k) for _ in range(rng.randint(2, 6))) for _ in range(n))
    letters = lambda i: "".join(chr(0x4E00 + 20 * i + j) for j in range(8))
    rows = [(f"long{i}", say(letters(i), 4000)) for i in range(6) for _ in range(2)]
    rows += [(f"one{i}", say(letters(10 + i), 60)) for i in range(12)]
    rows += [(f"same{i}", t) for i in range(6) for t in [say(letters(30 + i), 60)] * 100]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    models = language_id.train(labelled, sample_chars=2000)
    assert models.languages == sorted({k for k, _ in rows})
    assert np.isfinite(models.spread).all()
    docs = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(sorted(set(rows)))], "doc_id long, lang string, text string")
    got = language_id.classify(docs, models).join(docs, "doc_id")
    assert got.where("lang_pred <> lang or rejected").count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"aa": ["la", "mi", "so"], "bb": ["kk", "tz", "grü"]}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(k, 40), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "12", None), (None, say("aa", 30), None), (902, "", "bb"), (902, "漢" * 50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(df.where("doc_id < 60 or doc_id >= 900"))
    assert models.languages == ["aa", "bb"]
    got = language_id.classify(df, models).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == rows[r.doc_id][2] and not r.rejected for r in got if r.doc_id is not None and r.doc_id < 80)
    assert {(r.lang_pred, r.rejected) for r in got if r.doc_id in (900, 901)} == {("und", True)}
    assert language_id.keep_known(df, models).count() == 81
    none = language_id.train(df.where("lang = 'zz'"))
    assert {r.lang_pred for r in language_id.classify(df, none).collect()} == {"und"}
    assert language_id.keep_known(df, none).count() == 82


def test_token_shards_round_trip(docs, spark, tmp_path):
    written = token_output.write_tokens(docs, tmp_path.as_uri(), vocabulary=byte_bpe_path(), shard_bytes_=4000)
    assert written.count() > 2
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(byte_bpe_path())
    start, want = 0, []
    for i, text in corpus():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_output.read_index(written).collect()) == want
    path = written.orderBy("part").first().path.removeprefix("file://")
    shard = token_output.Shard(open(path, "rb").read())
    assert zlib.crc32(shard.ids(1).astype("<u4").tobytes()) == want[1][3]


def test_token_shards_of_odd_rows(odd, spark, tmp_path):
    """Repeated rows, a row that is there a thousand times, and rows without an id, which come last."""
    many = odd.unionByName(spark.createDataFrame([(0, "again and again " * 3)] * 1000, "doc_id long, text string"), allowMissingColumns=True)
    written = token_output.write_tokens(many, tmp_path.as_uri(), vocabulary=byte_bpe_path(), shard_bytes_=8000)
    got = sorted(token_output.read_index(written).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [0] * 1002 + [1, 1, 2, 3, None, None]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert written.agg(F.max("n_docs")).first()[0] < 400


def test_token_shards_of_nothing(docs, tmp_path):
    written = token_output.write_tokens(docs.limit(0), tmp_path.as_uri(), vocabulary=byte_bpe_path())
    assert token_output.read_index(written).count() == 0


def test_packing(docs, spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(byte_bpe_path())
    rows = packing.pack(docs, vocabulary=byte_bpe_path(), length=64).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and len(r.ids) == 4 * r.length for r in rows)
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in rows), reverse=True)
    for i, text in corpus():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 0] and own[0].doc_tokens == len(ids)
    assert packing.pack(docs.limit(0), vocabulary=byte_bpe_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(docs, vocabulary=byte_bpe_path(), length=100)


def test_packing_of_odd_rows(odd, spark):
    rows = packing.pack(odd, vocabulary=byte_bpe_path()).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id is None) >= 2 and sum(r.start == 0 for r in rows) == odd.count()
    many = spark.createDataFrame([(None, "a b c")] * 3000, "doc_id long, text string")
    got = packing.pack_index(many, vocabulary=byte_bpe_path())
    assert got.count() == 3000 and got.agg(F.max("sequence_id"), F.count_distinct("sequence_id")).first() == (2999, 3000)


def test_very_long_texts(spark):
    """Texts of over a slice: a passage and a benchmark item in them are found like in any other."""
    rng = random.Random(13)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, item = say(60), say(20)
    rows = [(1, f"{say(100_000)} {shared} {say(60_000)}"), (2, f"x {shared} y"), (3, f"{say(90_000)} {item} {say(70_000)}")]
    assert all(len(t) > words.SLICE_BYTES for i, t in rows if i != 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()}
    assert removed == {1: (160_060, 0), 2: (62, 60), 3: (160_020, 0)}
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in suffix_dedup.repeated_passages(df).collect()}
    assert spans == {1: [(100_000, 100_060)], 2: [(1, 61)]}
    found = {r.doc_id: [tuple(m) for m in r.matches] for r in decontaminate.matches(df, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()}
    assert found == {1: [], 2: [], 3: [("i", 90_000, 0, 20)]}


def test_decontamination(docs, odd, spark):
    shared = corpus()[14][1]
    items = spark.createDataFrame([(1, shared), (2, "nothing of this kind"), (3, None), (3, ""), (None, "be")], "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "item_ids", "hits", "matches", "longest"]
    key = lambda r: (str(r), len(str(r)))
    for table in (docs, odd, docs.unionByName(odd)):
        one = sorted((tuple(r) for r in decontaminate.matches(table, items).select(*columns).collect()), key=key)
        many = sorted((tuple(r) for r in decontaminate.matches(table, items, block_bytes=1).select(*columns).collect()), key=key)
        assert one == many and len(one) == table.count()
        left = [sorted(map(key, decontaminate.decontaminate(table, items, block_bytes=size).collect())) for size in (decontaminate.BLOCK_BYTES, 1)]
        assert left[0] == left[1] and len(left[0]) == sum(not (r[2] and 20 * r[2] >= r[1]) for r in one)
    got = {r.doc_id: r for r in decontaminate.matches(docs, items).collect()}
    assert (got[14].n_words, got[14].n_hit, got[14].item_ids, got[14].longest) == (60, 60, ["1"], 60)
    assert [tuple(m) for m in got[14].matches] == [("1", 0, 0, 60)] and [tuple(h) for h in got[6].hits] == [(0, 70)] and len(got[6].matches) == 70
    assert (got[7].n_words, got[7].n_hit, got[7].item_ids, got[7].matches, got[7].longest) == (0, 0, [], [], 0)
    assert decontaminate.matches(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.matches(docs.limit(0), items).count() == 0 == decontaminate.decontaminate(docs.limit(0), items, block_bytes=1).count()


def test_longest_matches_are_of_one_item(spark):
    """Two items that overlap in a text: the hits are united, the matches are not."""
    say = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    docs = spark.createDataFrame([(1, "x " + say(0, 30) + " y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, say(0, 15)), (2, "a b " + say(10, 30))], "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 1):
        r = decontaminate.matches(docs, items, block_bytes=size).first()
        assert [tuple(h) for h in r.hits] == [(1, 31)] and r.longest == 20
        assert [tuple(m) for m in r.matches] == [("1", 1, 0, 15), ("2", 11, 2, 20)]


def check_shards(rows, got, shards=8):
    """What holds of any sharding by bytes: whole rows, gapless slots, groups together, and those that are cut marked."""
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    groups, total = {}, [sum(r.size for r in got), sum(r.tokens for r in got), len(got)]
    for r in got:
        groups.setdefault((r.size, r.text_crc32), []).append(r)
    for own in groups.values():
        share = max(sum(r.size for r in own) / total[0], sum(r.tokens for r in own) / max(1, total[1]), len(own) / total[2])
        assert len({r.group_pieces for r in own}) == 1
        if share <= 1 / (shards * sharding.SPLIT):
            assert own[0].group_pieces == 1 and len({r.shard for r in own}) == 1
        else:
            assert len({r.shard for r in own}) <= own[0].group_pieces == int(np.ceil(share * shards * sharding.SPLIT - 1e-9))


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 300)))) for i in range(3000)] + [(None, "the same " * 20)] * 1500 + [(None, None), (1, ""), (1, "")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, got)
    # A third of the rows are copies, in pieces of a quarter of a shard's rows: with these, rows are less even than bytes.
    for size, most in (("size", 1.03), ("tokens", 1.03), (None, 1.1)):
        load = [sum(getattr(r, size) if size else 1 for r in got if r.shard == s) for s in range(8)]
        assert max(load) < most * sum(load) / 8, (size, load)


def test_sharding_over_many_tasks(spark):
    """Groups that are packed in several tasks, columns with clashing names and a very long text."""
    rng = random.Random(4)
    rows = [(i, "y" * rng.randint(1, 400) + f" {i // 3}") for i in range(4000)] + [(9000, "z " * 600_000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, "p") for i, t in rows], "doc_id long, text string, shard int, key int, size int, place string")
    got = sharding.shard(df, groups_per_task=500, large=64).collect()
    check_shards(rows, got)
    load = sorted(sum(r.size for r in got if r.shard == s) for s in range(8))
    assert load[-1] > 1_200_000 and max(load[:-1]) < 1.03 * sum(load[:-1]) / 7


def test_sharding_of_nothing(spark):
    out = sharding.shard(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "size", "tokens", "text_crc32", "shard", "slot", "group_pieces"]
    one = sharding.shard(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.size, r.slot) for r in one] == [(None, 1, 0)]


def test_chat(spark):
    rows = [(1, 0, "user", r"</s>[INST] \ok\ [/INST]<|im_end|>"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, "system", "s"), (2, 2, "assistant", "A"), (2, 1, "user", "u"), (3, 0, "<|x", "y"), (None, None, None, "z"), (None, 1, "user", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("segments")))
    assert sorted([tuple(t) for t in r.turns] for r in out.where("conv_id is null").collect()) == [[("", "z")], [("user", "w")]]
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", rows[0][3]), ("assistant", ""), ("assistant", "")]
    assert [tuple(t) for t in got[2].turns] == [("system", "s"), ("user", "u"), ("assistant", "A")] and got[2].loss == "A"
    assert [tuple(t) for t in got[3].turns] == [("<|x", "y")]
    assert (got[1].in_order, got[1].first_bad_turn, got[2].in_order, got[3].first_bad_turn) == (False, 2, True, 0)
    inside = got[1].formatted.removeprefix("<|im_start|>user<|im_sep|>").split("<|im_end|>")[0]
    assert not re.search(r"<\||</s>|\[INST|\[/INST", inside)
    with pytest.raises(ValueError):
        chat.Template(control=("x",))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).round(2)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(30)]
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None] * 4), (None, v[1].tolist()), (2400, [1.0, 2.0]), (2500, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = hnsw.build_index(df, shard_rows=100)
    got = {}
    for r in hnsw.search(index, df.where("vec_id % 100 = 0"), block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i, x in rows[:430]])
    flat = np.array([x for _, x in rows[:430]])
    hits = 0
    for q in (0, 100, 200, 300, 1000):
        d = np.sqrt(sum((flat[:, j] - flat[ids == q][0, j]) ** 2 for j in range(flat.shape[1])))  # added in order, as scores are
        d[ids == q] = np.inf
        want = [(k, int(ids[j]), float(d[j])) for k, j in enumerate(np.lexsort((ids, d))[:10], 1)]
        hits += len({x[1:] for x in want} & {x[1:] for x in got[q]})
        assert [x[0] for x in sorted(got[q])] == list(range(1, 14))
    assert hits >= 45 and sorted(got[2400]) == [(1, 2500, 0.5)] and got[2500] == [(1, 2400, 0.5)]
    assert not {2000, 2100, 2200, 2300} & set(got)
    with pytest.raises(ValueError):
        hnsw.search(index, df, k=11)


def test_nearest_neighbours_over_cells(spark):
    """Many cells of several shards, a vector that a third of the rows have, repeated ids and columns with clashing names: as
    brute force, but for what the search within a shard may miss."""
    rng = np.random.default_rng(8)
    flat = np.concatenate([np.repeat(rng.normal(size=(30, 8)), 30, 0) + 0.1 * rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 450, 0)]).round(4)
    ids = rng.permutation(len(flat))
    rows = [(int(i), x.tolist(), 0, 0, 0, 0.0, "s") for i, x in zip(ids, flat, strict=True)] + [(5, flat[0].tolist(), 0, 0, 0, 0.0, "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, cell int, shard int, score double, vector string")
    index = hnsw.build_index(df, shard_rows=60)
    assert len(index.centres[8]) > 10 and index.shards.count() >= index.cells.count()
    asked = df.where("vec_id % 9 = 0")
    got = {}
    for r in hnsw.search(index, asked, block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(len(flat)) if i % 9 == 0}
    own = {int(i): [] for i in ids}
    for i, x, *_ in rows:
        own[i].append(np.array(x))
    hits = 0
    for q, found in got.items():
        vector = min(map(tuple, own[q]))
        true = sorted((min(float(np.sqrt(((x - vector) ** 2).sum())) for x in xs), i) for i, xs in own.items() if i != q)[:10]
        hits += len({(i, round(d, 9)) for d, i in true} & {(v, round(s, 9)) for _, v, s in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 14))
    assert hits / (10 * len(got)) >= 0.98


def test_chat_columns_with_clashing_names_and_long_conversations(spark):
    turns = [(7, n, "user" if n % 2 == 0 else "assistant", f"t{n} <s>", 0, "x", "y") for n in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, alone int, row string, turns string")
    r = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).first()
    assert [tuple(t) for t in r.back] == [(x[2], x[3]) for x in turns] and r.in_order


def test_language_id_of_no_documents_and_clashing_names(spark):
    rows = [(i, "la mi so la mi " * 20, "aa", 0.5, True, "p", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected boolean, draw string, share int")
    models = language_id.train(df)
    assert language_id.classify(df.limit(0), models).count() == 0 and language_id.train(df.limit(0)).languages == []
    assert language_id.classify(df, models).columns == ["doc_id", "lang_pred", "score", "nats_per_char", "rejected"]
    assert language_id.keep_known(df, models).columns == df.columns


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert packing.pack(none, vocabulary=byte_bpe_path()).count() == 0 == simhash.deduplicate(none).count() == suffix_dedup.deduplicate(none).count()
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.repeated_passages(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.search(hnsw.build_index(empty), empty).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/documents.parquet").exists(), reason="no documents")
@pytest.mark.parametrize("left", [None, "en", "de"])
def test_languages_that_were_not_learned_are_rejected(spark, left):
    """By calibration alone: texts of a language that was left out go, those of the learned ones stay, held-back ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    models = language_id.train(learned if left is None else learned.where(F.col("lang") != left))
    got = language_id.classify(docs, models).join(docs.select("doc_id", "lang", F.length("text").alias("chars")), "doc_id").toPandas()
    foreign = (got["lang"] == left) & (got["chars"] >= 200)
    clean = (got["lang"] != left) & (got["lang_pred"] != "und")
    assert got[clean]["rejected"].mean() < 0.01
    assert left is None or got[foreign]["rejected"].mean() > 0.85
