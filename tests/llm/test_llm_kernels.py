import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import hnsw, language_id, sharding, simhash, token_output, tokenizing, words
from quarry.llm.decontaminate import TestSuffixes as Suffixes
from quarry.llm.decontaminate import _Lookup, _matches
from quarry.llm.elias_fano import EliasFano
from quarry.llm.packing import binary_pieces

TEXTS = st.lists(st.one_of(st.none(), st.text("ab \t\né漢\x00\x1c ", max_size=30)), max_size=6)


def grids(texts, separators=words.SPACE, most=words.SLICE_BYTES):
    for lo, hi, data, bounds in words.slices(pa.array(texts, pa.string()), most):
        yield lo, hi, words.words(data, bounds, separators)


@settings(deadline=None, max_examples=200)
@given(TEXTS, st.integers(1, 20))
def test_words_are_those_of_the_pattern(texts, most):
    got = [None] * len(texts)
    for lo, hi, grid in grids(texts, most=most):
        for i in range(hi - lo):
            got[lo + i] = [grid.data[a:b].tobytes().decode() for a, b in zip(grid.start[grid.first[i] : grid.first[i + 1]], grid.end[grid.first[i] : grid.first[i + 1]], strict=True)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_hashes_depend_on_words_alone():
    _, _, grid = next(grids(["x a bb a bb", "a bb a", "abb"]))
    h = grid.hashes()
    assert h[1] == h[3] == h[5] == h[7] and len(set(h.tolist())) == 4
    r = words.Rolling(h)
    assert r.of(np.array([1]), np.array([3])) == r.of(np.array([3]), np.array([5])) == r.windows(2)[5]


@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 12))
def test_sliding_minima(values, width):
    got = words.sliding_min(np.array(values, np.uint64), width).tolist()
    assert got == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=300), st.data())
def test_elias_fano(values, data):
    values.sort()
    code = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert code.slice(0, len(values)).tolist() == values
    assert [code.select(i) for i in range(len(values))] == values
    begin, end = data.draw(st.integers(0, len(values))), data.draw(st.integers(0, len(values) + 2))
    assert code.slice(begin, end).tolist() == values[begin:end]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(1).integers(0, 10**7, 10_000))
    assert len(EliasFano.encode(values).to_bytes()) * 8 / 10_000 < 2.5 + np.log2(10**7 / 10_000) + 0.5
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


@settings(deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=20), st.integers(0, 3))
def test_shards_have_their_document_ids(names, unnamed):
    names.sort()
    n = len(names) + unnamed
    data = token_output.shard_bytes(np.array(names, np.int64), unnamed, np.arange(n + 1) * 2, np.arange(2 * n), 2)
    shard = token_output.Shard(data)
    assert shard.doc_ids(0, n).to_pylist() == names + [None] * unnamed
    assert all(shard.doc_ids(i, i + 1).to_pylist() == [(names + [None] * unnamed)[i]] and shard.ids(i).tolist() == [2 * i, 2 * i + 1] for i in range(n))


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text("ab's t,.\n\t019é漢  　<|>😀endoftx\x1c\x85\xa0½ʰ̂'''revmlS", max_size=40), max_size=5))
def test_texts_have_the_ids_of_the_library(texts):
    encoder = tokenizing.encoder(tokenizing.byte_bpe_path())
    ids, bounds = encoder.encode(texts)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b c", "x\n<|endoftext|>\n y", "a  <|endoftext|>  b", "<|endoftext|> <|endoftext|><|endoftext|> it's", "<|endoftext| >"])
def test_special_tokens_have_the_ids_of_the_library(text):
    fresh = Tokenizer.from_file(tokenizing.byte_bpe_path())
    ids, _ = tokenizing.UnitEncoder(tokenizing.byte_bpe_path()).encode([text])
    assert ids.tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_ids_with_a_small_memory_and_long_units():
    encoder = tokenizing.UnitEncoder(tokenizing.byte_bpe_path(), most_units=3)
    for text in ["a b c d e", "e d c b a " + "x" * 500, "<|endoftext|> a", ""]:
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.n < 12


def test_every_character_is_of_the_librarys_kind():
    encoder = tokenizing.UnitEncoder(tokenizing.byte_bpe_path())
    texts = [f"{a}{chr(c)}{b}" for c in range(0x520) for a, b in (("a", "b"), ("1", " 2"), ("!", "?"), (" ", "\n"))]
    ids, bounds = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text("'srevtmld S!1 \n\té", max_size=14), max_size=6))
def test_contractions_and_blanks(texts):
    encoder = tokenizing.encoder(tokenizing.byte_bpe_path())
    ids, bounds = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_binary_pieces():
    owner, size = binary_pieces(np.array([0, 1, 1023, 1024, 2053]), 1024)
    got = {i: size[owner == i].tolist() for i in range(5)}
    assert got == {0: [], 1: [1], 2: [512, 256, 128, 64, 32, 16, 8, 4, 2, 1], 3: [1024], 4: [1024, 1024, 4, 1]}


def brute_print(text):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@settings(deadline=None)
@given(st.lists(st.text("aB é\n", max_size=25), max_size=5))
def test_fingerprints(texts):
    assert simhash.fingerprints_of(texts).tolist() == [brute_print(t) for t in texts]


def test_balls_meet_up_to_the_radius():
    masks = simhash.ball_masks(2)
    assert len(masks) == 65
    ball = {0 ^ m for m in masks}
    assert all(ball & {x ^ m for m in masks} for x in (0, 1, 1 << 40 | 1)) and not ball & {7 ^ m for m in masks}


def brute_hits(texts, items):
    pattern, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    cut = lambda t: pattern.findall((t or "").translate(low))
    windows = {}
    for k, item in enumerate(items):
        w = cut(item)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(k)
    out = []
    for t in texts:
        w, found = cut(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if ks := windows.get(tuple(w[s : s + n])):
                    found |= ks
                    hit[s : s + n] = [True] * n
        out.append((hit, found))
    return out


def brute_matches(texts, items):
    """(item, start, item_start, words) of matches that can't be drawn out to either side, by comparing word by word."""
    pattern, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    cut = lambda t: pattern.findall((t or "").translate(low))
    out = []
    for t in texts:
        w, own = cut(t), []
        for k, v in enumerate(map(cut, items)):
            for s in range(len(w)):
                for i in range(len(v)):
                    if s and i and w[s - 1] == v[i - 1]:
                        continue
                    n = 0
                    while s + n < len(w) and i + n < len(v) and w[s + n] == v[i + n]:
                        n += 1
                    if v and n >= min(13, len(v)):
                        own.append((k, s, i, n))
        out.append(sorted(own))
    return out


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 10**6))
def test_suffix_arrays_find_what_brute_force_finds(seed):
    rng = random.Random(seed)
    say = lambda n, k: rng.choice([" ", ", "]).join(rng.choice(["A", "b", "É", "7", "x"][:k]) for _ in range(n))
    items = [say(rng.choice([0, 1, 2, 4, 5, 8, 12, 13, 14, 20]), rng.choice([1, 2, 5])) for _ in range(4)] + [None]
    texts = [say(rng.randint(0, 40), 5) + " " + (rng.choice(items) or "") + " " + say(3, 5) for _ in range(4)] + [None, ""]
    tests = Suffixes.build([str(i) for i in range(len(items))], pa.array(items, pa.string()), 13)
    lookup, got, verbatim = _Lookup(tests.vocabulary), [], []
    for lo, hi, data, bounds in words.slices(pa.array(texts, pa.string()), rng.choice([1, 100, 10**6])):
        grid, hit, found = _matches(tests, lookup, data, bounds)
        got += [(hit[grid.first[i] : grid.first[i + 1]].tolist(), set(found[found[:, 0] == i, 1].tolist())) for i in range(hi - lo)]
        verbatim += [sorted(map(tuple, found[found[:, 0] == i, 1:].tolist())) for i in range(hi - lo)]
    assert got == brute_hits(texts, items)
    assert verbatim == brute_matches(texts, items)


def brute_kneser_ney(texts, asked, order=5, uniform=1 / 4096):
    """Log-probabilities of characters by interpolated Kneser-Ney with dictionaries, from its definition."""
    def normal(t):
        # A character that is no letter stays, as a space, only behind a letter.
        out, before = [], ""
        for c in t.lower():
            letter = unicodedata.category(c)[0] == "L"
            if letter or before == "L":
                out.append(c if letter else " ")
            before = "L" if letter else " "
        return " " * (order - 1) + "".join(out) + " "

    counts = [None] * (order + 1)
    counts[order] = Counter(t[i - order : i] for t in map(normal, texts) for i in range(order, len(t) + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, kinds = {}, {}, {}
    for n in range(1, order + 1):
        once, twice = sum(c == 1 for c in counts[n].values()), sum(c == 2 for c in counts[n].values())
        discount[n] = once / (once + 2 * twice) if once else 0.5
        total[n], kinds[n] = Counter(), Counter()
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else uniform
        context = g[:-1]
        if context not in total[n]:
            return lower
        return max(counts[n][g] - discount[n], 0) / total[n][context] + discount[n] * kinds[n][context] / total[n][context] * lower

    out = []
    for t in map(normal, asked):
        logs = [math.log(p(t[i - order : i])) for i in range(order, len(t) + 1)]
        out.append(-sum(logs) / len(logs))
    return out


def test_entropies_are_those_of_kneser_ney():
    rng = random.Random(6)
    say = lambda k, n: "".join(rng.choice(k) for _ in range(n))
    sets = {"x": "abcab de.é", "y": "xyz  wéa!"}
    texts = {k: [say(v, rng.randint(1, 60)) + "a" for _ in range(25)] for k, v in sets.items()}
    asked = [say("abcdexyz é1漢", rng.randint(1, 40)) + "b" for _ in range(30)] + ["a", "  a  b--c "]
    for table in (1 << 20, 300):  # all n-grams worked out in advance, and few of them
        models = language_id.LanguageModels(["x", "y"], [language_id.fit(texts[k]) for k in "xy"])
        models.prepare(table)
        assert len(models.known) <= table // 16
        h, n, _ = models.entropies(asked, models.index())
        want = np.array([brute_kneser_ney(texts[k], asked) for k in "xy"]).T
        assert h == pytest.approx(want, rel=2e-6)


def test_limits_lie_between_own_and_foreign_texts():
    """A language that was not learned is rejected, and texts of the learned ones are kept."""
    rng = random.Random(9)
    parts = {k: [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "r"]) for _ in range(14)] for k in "xyz"}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    models = language_id.LanguageModels(["x", "y"], [language_id.fit([say(k, 60) for _ in range(60)]) for k in "xy"])
    models.prepare()
    own = np.repeat([0, 1], 40)
    h, n, _ = models.entropies([say("xy"[k], 60) for k in own], models.index())
    models.calibrate(own, h[np.arange(80), own], n, 1 - own, h[np.arange(80), 1 - own], n)
    assert (models.spread[:, 2] < 100).all()
    clean, foreign = (models.predict([say(k, 60) for k in keys for _ in range(100)], models.index())[3] for keys in ("xy", "z"))
    assert clean.mean() == 0 and foreign.mean() > 0.9


def test_probabilities_sum_to_one_and_languages_are_told_apart():
    rng = random.Random(5)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    sets = {"x": ["la", "mi", "so", "ré"], "y": ["kk", "tz", "gro", "ü"]}
    texts = {k: [make(v, 60) for _ in range(30)] for k, v in sets.items()}
    models = language_id.LanguageModels(["x", "y"], [language_id.fit(texts[k]) for k in "xy"])
    models.prepare()
    h, n, _ = models.entropies([make(sets[k], 40) for k in "xy" for _ in range(10)], models.index())
    own = np.array([0] * 10 + [1] * 10)
    models.calibrate(own, h[np.arange(20), own], n)
    letters = np.unique(language_id.characters(texts["x"])[0])
    for context in (language_id.characters(["lami so"])[0][:9], np.array([113] * 6, np.uint32)):
        p = [np.exp(models._log(np.append(context, c).astype(np.uint64), np.array([len(context)]))[0, 0], dtype=float) for c in [*letters, 0x4E00]]
        assert abs(sum(p[:-1]) + (4096 - len(letters)) * p[-1] - 1) < 1e-3  # the rest is for characters that were never seen
    names, score, _, rejected = models.predict([make(sets["x"], 20), make(sets["y"], 20), "12 34", "", "漢字" * 40], models.index())
    assert names[:4] == ["x", "y", "und", "und"] and score[2] == 0 and 0 <= score.min() <= score.max() <= 1
    assert rejected.tolist() == [False, False, True, True, True]


def brute_bins(items, bins):
    """The dot-product rule, item by item, in plain Python."""
    total = [sum(c) for c in zip(*items, strict=True)]
    share = [[x / t for x, t in zip(i, total, strict=True)] for i in items]
    left, out = [[1 / bins] * 3 for _ in range(bins)], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(share[i]), i)):
        products = [sum(a * b for a, b in zip(row, share[i], strict=True)) for row in left]
        out[i] = products.index(max(products))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], share[i], strict=True)]
    return out


def test_bins_are_even_and_those_of_the_rule():
    rng = np.random.default_rng(3)
    items = rng.pareto(1.5, (2000, 3)) + 1
    room = np.ones((8, 1)) * items.sum(0) / 8
    bins = sharding.pack_vectors(items, room)
    load = np.stack([items[bins == b].sum(0) for b in range(8)]) / items.sum(0)
    assert np.abs(load * 8 - 1).max() < 0.05
    assert room == pytest.approx((1 / 8 - load) * items.sum(0), abs=1e-6 * items.sum())
    assert np.mean(bins == brute_bins(items.tolist(), 8)) > 0.98  # products that are equal but for rounding may differ


def graph_recall(vectors, ids, step):
    graph = hnsw.Graph.build(ids, vectors)
    some = np.arange(0, len(vectors), step)
    found = hnsw._best(graph, ids[some], vectors[some], 10, hnsw.BEAM).to_pydict()
    got = {}
    for q, v, s in zip(found["rep"], found["vec_id"], found["score"], strict=True):
        if v != q:
            got.setdefault(q, []).append((s, v))
    hits = 0
    for i in some:
        d = np.sqrt(sum((vectors[:, j] - vectors[i, j]) ** 2 for j in range(vectors.shape[1])))  # added in order, as scores are
        d[i] = np.inf
        true = {(float(d[j]), int(ids[j])) for j in np.lexsort((ids, d))[:10]}
        hits += len(true & set(got[ids[i]][:10]))
    return graph, hits / (10 * len(some))


def test_graph_recall_and_copies():
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))).round(3)
    vectors[500:900] = vectors[0]  # a large group of copies is one node
    ids = rng.permutation(1500) * 7
    graph, recall = graph_recall(vectors, ids, 10)
    assert len(graph.vectors) == 1100 and sorted(graph.ids.tolist()) == sorted(ids.tolist())
    assert recall >= 0.9


@pytest.mark.parametrize("clusters, size, dim", [(64, 60, 64), (40, 100, 16), (16, 250, 64), (64, 64, 4), (1, 3000, 64)])
@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_graph_recall_on_clusters(clusters, size, dim, spread):
    """Clusters that are larger than a node's links, tight and loose, and one without structure."""
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.normal(size=(clusters, dim)), size, 0) + spread * rng.normal(size=(clusters * size, dim))
    graph, recall = graph_recall(vectors, rng.permutation(len(vectors)), 13)
    assert recall >= 0.9
    for nodes, rows in zip(graph.nodes, graph.neighbours, strict=True):
        assert rows.shape == (len(nodes), rows.shape[1]) and rows.max(initial=0) < len(nodes)
        assert all(len(set(r[r >= 0].tolist()) - {i}) == (r >= 0).sum() for i, r in enumerate(rows))  # distinct others


def test_graph_of_extreme_numbers():
    vectors = np.array([[1e200, 0], [-1e200, 0], [1e200, 1e190], [1e-300, 1], [3e-300, 1]])
    graph = hnsw.Graph.build(np.arange(5), vectors)
    found = hnsw._best(graph, np.arange(5), vectors, 2, 10).to_pydict()
    assert found["vec_id"][:2] == [0, 2] and np.isfinite(found["score"]).all() and found["score"][1] == pytest.approx(1e190)


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6), st.integers(0, 40), st.integers(1, 3))
def test_graphs_of_any_size_find_everything(seed, n, dim):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(0, 4, (n, dim)).astype(float)
    graph = hnsw.Graph.build(np.arange(n), vectors, links=2, candidates=4)
    if n:
        found = hnsw._best(graph, np.arange(n), vectors, n, 10 * n).to_pydict()
        assert found["vec_id"] == [j for i in range(n) for j in np.lexsort((np.arange(n), ((vectors - vectors[i]) ** 2).sum(1))).tolist()]
