"""Language identification with interpolated Kneser-Ney character models.

For each language a model over n-grams of up to five characters is fitted on a bounded sample of labelled texts. Its
discounted probabilities and back-off weights are kept in arrays sorted by the n-grams' hashes. A text gets the
language of the lowest cross-entropy per character. Texts are lower-cased, and each run of characters that are not letters
is one space.

Training sample: every language is learned. SAMPLE_CHARS characters of each are expected in it, or TOTAL_CHARS divided by
the languages if that is less; so models are of bounded size, however many languages there are. It is drawn by a hash of
the text, and equal texts count once. Long texts are drawn in pieces of a hundredth of that, and the piece with a
language's least hash is always in. One fifth of the sample calibrates; a language without a text there is calibrated with
the halves of its others.

Rejection: a text is rejected whose entropy is further above its language's mean, in standard deviations for its length,
than the language's limit. Held-back texts set it from both sides: it lies between where the language's own texts end and
where those of other languages begin, scored as if their own had not been learned.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, kept_rows, own_columns, prepare, tidy
from quarry.llm.words import mix

ORDER = 5
SAMPLE_CHARS, TOTAL_CHARS = 1_000_000, 8_000_000
#: Bytes of the table of n-grams whose log-probabilities are worked out in advance; others are backed off when they come.
TABLE_BYTES = 64 << 20
#: Characters whose difference in cross-entropy the score weighs.
EVIDENCE_CHARS = 10
#: The limit is WAY of the way from MARGIN times this quantile of the deviations of own texts to that quantile of those of other
#: languages' texts. Of these only windows of FOREIGN_CHARS characters count in whose text each window is nearest to the
#: text's own language: in a text of mixed languages some part is this one's own. The quantile of a language's own texts is drawn to
#: that of all languages' as if it were POOLED texts more: a few texts alone don't show how far others lie.
OWN, MARGIN, FOREIGN, FOREIGN_CHARS, WAY, POOLED = 0.999, 2.0, 0.05, 200, 0.25, 20
#: The deviation between texts counts as this many nats a character at least, and 1 for a single character.
LEAST_SPREAD = 0.1
UNKNOWN = "und"
_UNIFORM = 1 / 4096
_BASE = 0xA24BAED4963EE407
_SLICE_CHARS = 1 << 19
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, bounds, letters): the normalised characters of texts, with ORDER - 1 spaces before and one behind each, where
    text i lies in codes[bounds[i]:bounds[i + 1]], and how many letters it has."""
    lower = [t.lower() for t in texts]
    pad, end = "\0" * (ORDER - 1), "\0"
    codes = np.frombuffer("".join(pad + t + end for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + ORDER)])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= codes == 0
    total = np.concatenate([[0], np.cumsum(keep)])
    many = np.concatenate([[0], np.cumsum(letter)])
    return np.where(letter, codes, np.uint32(32))[keep], total[bounds], np.diff(many[bounds])


def _hash(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each place."""
    out = np.full(len(at), n, np.uint64)
    base = np.uint64(_BASE)
    for j in range(n - 1, -1, -1):
        out = out * base + codes[at - j]
    return mix(out)


def _predicted(bounds: np.ndarray) -> np.ndarray:
    """Places of the characters that are predicted: all but the spaces before each text."""
    n = np.diff(bounds) - (ORDER - 1)
    return np.repeat(bounds[:-1] + ORDER - 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())


def fit(texts: list[str]) -> dict[str, np.ndarray]:
    """Arrays of an interpolated Kneser-Ney model: for each order n the sorted hashes g{n} of n-grams with their discounted
    probabilities p{n}, and the sorted hashes c{n} of contexts with their back-off weights w{n}."""
    codes, bounds, _ = characters(texts)
    codes = codes.astype(np.uint64)
    at = _predicted(bounds)
    out: dict[str, np.ndarray] = {}
    count = None
    for n in range(ORDER, 0, -1):
        grams, first, count = np.unique(_hash(codes, at, n), return_index=True, return_counts=True)
        if n == ORDER:
            out["codes"] = codes[at[first][:, None] + np.arange(1 - ORDER, 1)].astype(np.uint32)
            out["times"] = count
        at = at[first]  # one place of each n-gram; below, each longer n-gram counts once (continuation counts)
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        discount = once / (once + 2 * twice) if once else 0.5
        contexts, which, types = np.unique(_hash(codes, at - 1, n - 1) if n > 1 else np.zeros(len(at), np.uint64), return_inverse=True, return_counts=True)
        total = np.bincount(which, count, minlength=len(contexts))
        out |= {f"g{n}": grams, f"p{n}": (count - discount).clip(0) / total[which], f"c{n}": contexts, f"w{n}": discount * types / total}
    return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _probabilities(model: dict[str, np.ndarray], hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    """Of n-grams whose last n characters have hashes[n - 1], and the n - 1 before the last one contexts[n - 1]."""
    p = np.full(len(hashes[0]), _UNIFORM)
    for n in range(1, ORDER + 1):
        p = _find(model[f"g{n}"], model[f"p{n}"], hashes[n - 1], 0.0) + _find(model[f"c{n}"], model[f"w{n}"], contexts[n - 1], 1.0) * p
    return p


@dataclass
class LanguageModels:
    """Models of all languages. Of the n-grams of full order that come most often, the log-probabilities in every language are
    worked out in advance; others are backed off when they come, to the same values."""

    languages: list[str]
    models: list[dict[str, np.ndarray]]
    known: np.ndarray | None = None
    logs: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # by language: variance between texts, variance of a character, limit in deviations

    def _lower(self, codes: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        hashes = [_hash(codes, at, n) for n in range(1, ORDER + 1)]
        return hashes, [np.zeros(len(at), np.uint64), *(_hash(codes, at - 1, n - 1) for n in range(2, ORDER + 1))]

    def _log(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        hashes, contexts = self._lower(codes, at)
        return np.log(np.stack([_probabilities(m, hashes, contexts) for m in self.models], 1)).astype(np.float32)

    def prepare(self, table_bytes: int = TABLE_BYTES) -> None:
        """Work out the n-grams of full order that the models know, the most frequent ones up to the size of the table."""
        codes = np.concatenate([np.zeros((0, ORDER), np.uint32), *(m.pop("codes") for m in self.models)])
        times = np.concatenate([np.zeros(0, np.int64), *(m.pop("times") for m in self.models)])
        known = _hash(codes.ravel().astype(np.uint64), np.arange(ORDER - 1, codes.size, ORDER), ORDER)
        known, first, back = np.unique(known, return_index=True, return_inverse=True)
        most = table_bytes // (8 + 4 * max(1, len(self.models)))
        if len(known) > most:
            kept = np.sort(np.argsort(-np.bincount(back, times), kind="stable")[:most])
            known, first = known[kept], first[kept]
        flat, at = codes[first].ravel().astype(np.uint64), np.arange(ORDER - 1, ORDER * len(first), ORDER)
        parts = [self._log(flat, at[i : i + 100_000]) for i in range(0, len(at), 100_000)]
        self.known, self.logs = known, np.concatenate([np.zeros((0, len(self.models)), np.float32), *parts])

    def index(self) -> np.ndarray:
        """Where in `known` the hashes with given top bits begin."""
        return np.searchsorted(self.known, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32) if len(self.known) else np.zeros((1 << 20) + 1, np.int32)

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray, index: np.ndarray) -> np.ndarray:
        wanted = _hash(codes, at, ORDER)
        top = (wanted >> np.uint64(44)).astype(np.int64)
        place, end = index[top], index[top + 1]
        todo = np.flatnonzero(place < end)
        row = np.full(len(at), -1, np.int32)
        place, end, wanted_ = place[todo], end[todo], wanted[todo]
        while len(todo):
            same = self.known[place] == wanted_
            row[todo[same]] = place[same]
            more = ~same & (place + 1 < end)
            todo, place, end, wanted_ = todo[more], place[more] + 1, end[more], wanted_[more]
        out = self.logs[row] if len(self.known) else np.zeros((len(at), len(self.models)), np.float32)
        unseen = np.flatnonzero(row < 0)
        if len(unseen):
            _, first, back = np.unique(wanted[unseen], return_index=True, return_inverse=True)
            out[unseen] = self._log(codes, at[unseen[first]])[back]
        return out

    def entropies(self, texts: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per character in each language, characters, letters) of each text."""
        codes, bounds, letters = characters(texts)
        codes = codes.astype(np.uint64)
        n = np.diff(bounds) - (ORDER - 1)
        logs = self.log_probabilities(codes, _predicted(bounds), index)
        starts = np.cumsum(n) - n
        return -np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / n[:, None], n, letters

    def calibrate(self, own: np.ndarray, h: np.ndarray, n: np.ndarray, other: np.ndarray | None = None, h_other: np.ndarray | None = None, n_other: np.ndarray | None = None) -> None:
        """Means, spreads and limits from held-back texts: the language of each, its entropy in it, and its characters; and from windows
        of pure texts: the best of the languages that aren't theirs, the entropy in that one, and their characters."""
        self.mean, self.spread = np.zeros(len(self.models)), np.zeros((len(self.models), 3))
        deviations: dict[int, np.ndarray] = {}
        for k in range(len(self.models)):
            mine = np.flatnonzero(own == k)
            if not len(mine):
                self.spread[k] = 0, 0, np.inf
                continue
            mine_h, mine_n = h[mine], n[mine]
            mean = float(np.average(mine_h, weights=mine_n))
            # Squared deviations are v + c / n: a least-squares fit, neither part negative.
            deviation = (mine_h - mean) ** 2
            a = np.stack([np.ones(len(mine)), 1 / mine_n], 1)
            v, c = np.clip(np.linalg.lstsq(a, deviation, rcond=None)[0], 0, None)
            v, c = max(v, LEAST_SPREAD**2), max(c, 1.0)
            deviations[k] = (mine_h - mean) / np.sqrt(v + c / mine_n)
            self.mean[k], self.spread[k] = mean, (v, c, 0)
        pooled = float(np.quantile(np.concatenate(list(deviations.values())), OWN)) if deviations else 0.0
        furthest = np.zeros(len(self.models))
        for k, own_ones in deviations.items():
            furthest[k] = MARGIN * (len(own_ones) * float(np.quantile(own_ones, OWN)) + POOLED * pooled) / (len(own_ones) + POOLED)
            self.spread[k, 2] = furthest[k]
        if other is None:
            return
        for k in range(len(self.models)):
            theirs = np.flatnonzero(other == k)
            if len(theirs) and np.isfinite(self.spread[k, 2]):
                v, c, _ = self.spread[k]
                limit = float(np.quantile((h_other[theirs] - self.mean[k]) / np.sqrt(v + c / n_other[theirs]), FOREIGN))
                self.spread[k, 2] = furthest[k] + max(0.0, WAY * (limit - furthest[k]))

    def predict(self, texts: list[str], index: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, nats per character, rejected) of each text."""
        if not self.models:
            letters = characters(texts)[2]
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), letters == 0
        h, n, letters = self.entropies(texts, index)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp((low[:, None] - h) * EVIDENCE_CHARS).sum(1)
        v, c, most = self.spread[best].T
        rejected = (low - self.mean[best] > most * np.sqrt(v + c / n)) | (letters == 0)
        none = letters == 0
        names = [UNKNOWN if x else self.languages[k] for x, k in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, score), np.where(none, np.nan, low), rejected


def _pack(model: dict[str, np.ndarray]) -> bytes:
    np.savez(out := io.BytesIO(), **model)
    return out.getvalue()


def _fit_group(key: tuple, table: pa.Table) -> pa.Table:
    texts = table.column("text").to_pylist()
    return pa.table({"lang": [key[0].as_py()], "model": pa.array([_pack(fit(texts))], pa.binary())})


def _held_back(sent):
    """Entropies of texts in their own languages, and of the windows of pure texts in the best of the others. own is -1 in a row of a
    window, other in one of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        index, place = models.index(), {k: i for i, k in enumerate(models.languages)}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, n, letters = models.entropies([text], index)
                if not letters[0] or lang not in place:
                    continue
                own, parts = place[lang], [text[i : i + FOREIGN_CHARS] for i in range(0, len(text) - FOREIGN_CHARS + 1, FOREIGN_CHARS)]
                yield pa.RecordBatch.from_pydict({"own": [own], "other": [-1], "h": [float(h[0, own])], "n": [int(n[0])]})
                if parts and len(place) > 1:
                    h, n, _ = models.entropies(parts, index)
                    if (h.argmin(1) == own).all():
                        h[:, own] = np.inf
                        yield pa.RecordBatch.from_pydict({"own": [-1] * len(h), "other": h.argmin(1).tolist(), "h": h.min(1).tolist(), "n": n.tolist()})

    return run


def _crossed(key: tuple, table: pa.Table) -> pa.Table:
    """Entropies of each half of a language's texts in a model of the other halves."""
    texts = table.column("text").to_pylist()
    halves = [t[: len(t) // 2] for t in texts], [t[len(t) // 2 :] for t in texts]
    found = []
    for fitted, judged in (halves, halves[::-1]):
        models = LanguageModels([key[0].as_py()], [fit(fitted)])
        models.prepare()
        h, n, letters = models.entropies(judged, models.index())
        found += [(float(x[0]), int(k)) for x, k, some in zip(h, n, letters, strict=True) if some]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(found), pa.string()), "h": pa.array([x for x, _ in found], pa.float64()), "n": pa.array([k for _, k in found], pa.int64())})


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> LanguageModels:
    """Fit and calibrate on rows with a language and a text with something in it.

    Sizes are summed over all rows; then each language's texts are drawn with the share that its part of the sample is of
    its distinct characters. Each language is fitted in a task of its own, on its bounded sample, and the held-back texts
    are scored where they are: what comes to the driver is models and numbers. Without labelled rows there are no
    languages.
    """
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and length(text) > 0")
    languages = rows.agg(F.count_distinct("lang")).first()[0]
    if not languages:
        return LanguageModels([], [], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 3)))
    sample_chars = min(sample_chars, max(1, total_chars // languages))
    most = max(ORDER, sample_chars // 100)
    pieces = F.when(F.length("text") > most, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{most}}}"), F.lit(0))).otherwise(F.array("text"))
    drawn = rows.select("lang", F.explode(pieces).alias("text")).withColumn("draw", F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53)))
    distinct = drawn.groupBy("lang", "draw").agg(F.max(F.length("text")).alias("own"))
    share = (F.lit(float(sample_chars)) / F.sum("own")).alias("share")
    # A row a language: the models, which the driver holds, are as many.
    sizes = F.broadcast(distinct.groupBy(F.col("lang").alias("_lang")).agg(share, F.min("draw").alias("least")))
    fold = F.when(F.col("draw") == F.col("least"), 1).otherwise(F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(5)))
    chosen = drawn.join(sizes, F.col("lang") == F.col("_lang")).where((F.col("draw") < F.col("share")) | (F.col("draw") == F.col("least")))
    sample = Workspace(spark, "language-id").table(chosen.withColumn("fifth", fold).select("lang", "text", "fifth").dropDuplicates(["lang", "text"]), "sample")
    fitted = {r["lang"]: r["model"] for r in sample.where("fifth > 0").select("lang", "text").groupBy("lang").applyInArrow(_fit_group, "lang string, model binary").toLocalIterator()}
    languages = sorted(fitted)
    out = LanguageModels(languages, [dict(np.load(io.BytesIO(fitted.pop(k)))) for k in languages])
    out.prepare()
    sent = spark.sparkContext.broadcast(out)
    held = sample.where("fifth = 0").select("lang", "text").mapInArrow(tidy(_held_back(sent)), "own long, other long, h double, n long").toPandas()
    sent.unpersist()
    texts, windows = held[held["own"] >= 0], held[held["own"] < 0]
    own, h, n = (texts[c].to_numpy(t) for c, t in (("own", int), ("h", float), ("n", float)))
    other, h_other, n_other = (windows[c].to_numpy(t) for c, t in (("other", int), ("h", float), ("n", float)))
    without = [k for i, k in enumerate(languages) if i not in set(own.tolist())]
    if without:
        halves = sample.where(F.col("lang").isin(without)).select("lang", "text").groupBy("lang").applyInArrow(_crossed, "lang string, h double, n long").toPandas()
        own = np.concatenate([own, [languages.index(k) for k in halves["lang"]]]).astype(int)
        h, n = np.concatenate([h, halves["h"].to_numpy(float)]), np.concatenate([n, halves["n"].to_numpy(float)])
    out.calibrate(own, h, n, other, h_other, n_other)
    return out


def _predictions(models: LanguageModels, index: np.ndarray, column: pa.Array) -> Iterator[tuple[int, int, tuple]]:
    """(from row, to row, prediction) of parts of a column of texts."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= _SLICE_CHARS):
            size += len(texts[to])
            to += 1
        yield at, to, models.predict(texts[at:to], index)
        at = to


def _classifier(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        index = models.index()
        for batch in batches:
            for at, to, (names, score, nats, rejected) in _predictions(models, index, batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.array(names, pa.string()), pa.array(score), pa.array(nats), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "nats_per_char", "rejected"],
                )

    return run


def _keeper(sent, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        index = models.index()
        for batch in batches:
            for at, to, (_, _, _, rejected) in _predictions(models, index, batch.column(text_col)):
                yield batch.slice(at, to - at).filter(pa.array(~rejected))

    return run


def classify(docs: DataFrame, models: LanguageModels, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, nats_per_char and rejected of every row, from its whole text alone.

    A text that is null or has no letter is `und` with score 0 and is rejected. Where no language was learned every
    text is `und`, and only those without letters are rejected. Repeated rows and null ids are rows like any other.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    return own_columns(docs, id_col, text_col).mapInArrow(tidy(_classifier(sent)), "doc_id long, lang_pred string, score double, nats_per_char double, rejected boolean")


def keep_known(docs: DataFrame, models: LanguageModels, *, text_col: str = "text") -> DataFrame:
    """The documents, all their columns unchanged, that are not rejected: judged row by row, without a join."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    return kept_rows(docs, text_col, lambda name: _keeper(sent, name))
