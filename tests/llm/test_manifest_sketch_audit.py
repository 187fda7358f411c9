import hashlib
import random
import re
import zlib
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import filter_audit, merkle, odd_sketch, words

EXTRA = "node string, at long, tree string, path string, `my col` string, place long, sid long, mask int, part string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
PAD = ("n", 1, "t", "p", "m", 2, 3, 4, "q")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA).repartition(parts)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grow(nodes):
    """All levels of a tree."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def way(levels, at):
    """(on the left, sibling) of each level below the root."""
    return [((at >> k) & 1 == 1, level[s] if (s := (at >> k) ^ 1) < len(level) else None) for k, level in enumerate(levels[:-1])]


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r)))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    low = {lang: grow(x[2] for x in sorted(trees[lang])) for lang in order}
    high = grow(low[lang][-1][0] for lang in order)
    out = []
    for n, lang in enumerate(order):
        for at, (named, i, leaf) in enumerate(sorted(trees[lang])):
            out.append((i if named else None, leaf, low[lang][-1][0], high[-1][0], way(low[lang], at) + way(high, n)))
    return out


@pytest.mark.parametrize(("sizes", "levels"), [([1], 2), ([2, 1], 1), ([5, 17, 1, 64], 2), ([65, 33, 3], 3), ([70, 4], 8)])
def test_manifest(spark, sizes, levels):
    rng = random.Random(sum(sizes))
    langs = [None, "", "é", "zz", "a"][: len(sizes)]
    rows = [(rng.randrange(1000), rng.choice(["a b", "", None, "ü:1"]), lang, rng.choice(["s", None]), rng.choice([None, 3])) for lang, n in zip(langs, sizes, strict=True) for _ in range(n)]
    rows += rows[:1] + [(None, *rows[0][1:])]  # a repeated row, and one without an id
    got = merkle.manifest(table(spark, rows), levels=levels).collect()
    have = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [(s.left, s.node) for s in r.path]) for r in got)
    want = sorted((str(r[0]), *r[1:]) for r in brute_manifest(rows))
    # Rows that are alike have the same leaf and may take each other's place.
    assert [x[:4] for x in have] == [x[:4] for x in want] and sorted(str(x[4]) for x in have) == sorted(str(x[4]) for x in want)


def test_manifest_shows_what_was_changed(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "fr", "s", i) for i in range(40)]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf(*(F.col(c) if c != "n_chars" else F.col(c) + 1 for c in ("doc_id", "source", "lang", "n_chars", "text"))))
    found = merkle.manifest(table(spark, rows), carry={"changed": changed}, levels=2)
    got = found.select("doc_id", (merkle.fold(F.coalesce("changed", "leaf"), F.col("path")) == F.col("root")).alias("same"), (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("own")).collect()
    assert len(got) == 40 and all(r.own for r in got)
    assert {r.doc_id for r in got if not r.same} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0} != set()


def test_manifest_of_nothing(spark):
    assert merkle.manifest(table(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="nodes"):
        merkle.manifest(table(spark, []), levels=0)


# Odd sketches


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, percent=85):
    """The component of each row by all pairs."""
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            of[root(j)] = root(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(rows)), key=str)


def say(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]


def changed(rng, w, n):
    w = list(w)
    for at in rng.sample(range(len(w)), n):
        w[at] = "x" + str(rng.randrange(10**6))
    return w


def near_rows(seed):
    """Groups of edited copies around the threshold, chains, exact copies, short texts, nulls."""
    rng = random.Random(seed)
    texts = []
    for n in (12, 40, 90, 300):
        base = say(rng, n)
        texts += [base, [x.upper() for x in base], base] + [changed(rng, base, rng.randint(1, max(1, n // 30))) for _ in range(25)]
        link = base
        for _ in range(6):  # each near the one before, the ends far from each other
            link = changed(rng, link, max(1, n // 80))
            texts.append(link)
    texts += [say(rng, 60) for _ in range(30)] + [["a"], ["a"], ["A", "b"], ["a", "b"], ["be"] * 200, ["be"] * 300]
    rows = [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (None, "only here once more and again"), rows[3], (2003, "é" * 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_sketch(spark, seed):
    rows = near_rows(seed)
    got = odd_sketch.near_duplicates(table(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_odd_sketch_of_a_large_group(spark, monkeypatch):
    """One group of edited copies that are near its base and not near each other, in many blocks."""
    monkeypatch.setattr(odd_sketch, "BLOCK", 8)
    monkeypatch.setattr(odd_sketch, "SPREAD", 4)
    rng = random.Random(5)
    base = say(rng, 200)
    rows = [(i + 10, " ".join(changed(rng, base, rng.choice([2, 3, 4, 5, 9])))) for i in range(120)] + [(5, " ".join(base))]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:60])]
    got = odd_sketch.near_duplicates(table(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)
    assert len({r.component_id for r in got}) > 5  # some are too far from all


def test_odd_sketch_of_nothing(spark):
    assert odd_sketch.near_duplicates(table(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="80"):
        odd_sketch.near_duplicates(table(spark, []), percent=50)


def test_population_counts_estimate_similarities():
    """No pair at the threshold is lost; of pairs well below it few stay."""
    rng = np.random.default_rng(3)
    for n in (20, 300, 3000, 30000):
        kept = {}
        for share in (0.85, 0.65):
            common = round(2 * n * share / (1 + share))
            near = 0
            for _ in range(40):
                h = np.unique(words.mix(rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)))
                a, b = h[:n], np.concatenate([h[:common], h[n : 2 * n - common]])
                sketch = odd_sketch.odd_sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]))
                near += bool(odd_sketch.could_link(np.array([len(a)]), np.array([len(b)]), np.bitwise_count(sketch[:1] ^ sketch[1:]).sum(1))[0])
            kept[share] = near
        assert kept[0.85] == 40
        assert n < 100 or kept[0.65] <= 4


# Filter interaction audit


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.append((lang or "", {x for x, f in fails.items() if f}, i in good and i is not None, i in toxic and i is not None))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                failing = [d for d in own if x in d[1]]
                left = [d for d in left if x not in d[1]]
                out.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), x])
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return sorted((*r[:9], shapley[r[0], r[9]]) for r in out)


def test_filter_audit(spark):
    rng = random.Random(4)
    plain = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = [plain(250), plain(250), plain(10), "to be " * 120, plain(220) + " # and *", "ABC DEF " + plain(3), "", None, plain(400) + " X", " \t\n", "a" * 100_000]
    rows = [(rng.randrange(40), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(150)] + [(None, texts[0], "en"), (None, None, None), (500, texts[0], "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(2, 1, 1), (None, 1, 1), (999, 1, 1)]
    docs = table(spark, [(i, t, lang, None, None) for i, t, lang in rows])
    cells = filter_audit.cells(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = sorted(tuple(r) for r in filter_audit.audit(cells, "ABCDE").collect())
    assert got == brute_audit(rows, labels)


def test_filter_audit_of_other_filters(spark):
    rows = [(1, "a", "x", None, None), (2, "b", "x", None, None), (3, "ab", "x", None, None)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = filter_audit.cells(table(spark, rows), none, {"A": F.contains("text", F.lit("a")), "B": F.contains("text", F.lit("b"))})
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(cells, "AB").collect()}
    assert got == {("AB", 1): (1, 2, 0, 1, 3), ("AB", 2): (0, 1, 1, 1, 3), ("BA", 1): (1, 2, 0, 1, 3), ("BA", 2): (0, 1, 1, 1, 3)}
    assert filter_audit.audit(filter_audit.cells(table(spark, []).limit(0), none), "ABCDE").count() == 0
    with pytest.raises(ValueError, match="letters"):
        filter_audit.audit(cells, "AA")
