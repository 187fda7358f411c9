"""Model services as interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import ClassVar, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def scores(self, queries: list[str], texts: list[str]) -> list[float]: ...


class EntityExtractor(Protocol):
    def extract(self, text: str) -> list[dict]: ...


class Chat(Protocol):
    def answer(self, messages: list[dict]) -> str: ...


class Translator(Protocol):
    def translate(self, text: str, language: str) -> str: ...


class PerWorker:
    """A model that each Python worker makes for itself when it first asks it, and keeps for later tasks. Only its name and how it
    is made are sent; models of one name are the same."""

    held: ClassVar[dict[str, object]] = {}

    def __init__(self, name: str, make: Callable[[], object]):
        self.name, self.make = name, make

    def __reduce__(self):
        return PerWorker, (self.name, self.make)

    def __getattr__(self, attribute: str):
        if attribute.startswith("__"):
            raise AttributeError(attribute)
        if self.name not in PerWorker.held:
            PerWorker.held[self.name] = self.make()
        return getattr(PerWorker.held[self.name], attribute)


@dataclass
class HashedEmbedder:
    """Counts of character trigrams in hashed places, of length 1."""

    dim: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            low = re.sub(r"\s+", " ", text.lower()).strip()
            for i in range(max(1, len(low) - 2)):
                h = zlib.crc32(low[i : i + 3].encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


@dataclass
class OverlapReranker:
    """The share of a question's words that a text has."""

    def scores(self, queries: list[str], texts: list[str]) -> list[float]:
        def words(s: str) -> set[str]:
            return set(re.findall(r"\w+", s.lower()))

        return [len(words(q) & words(t)) / max(1, len(words(q))) for q, t in zip(queries, texts, strict=True)]


@dataclass
class DictionaryExtractor:
    """Names from a list that a text holds, at most `most` of them."""

    names: dict[str, str]
    most: int = 12

    def extract(self, text: str) -> list[dict]:
        low = text.lower()
        found = [n for n in self.names if n.lower() in low]
        return [{"name": n, "type": self.names[n], "aliases": [], "confidence": "high"} for n in found[: self.most]]


@dataclass
class ExtractiveChat:
    """Answers with the beginning of the context it is given."""

    most: int = 400

    def answer(self, messages: list[dict]) -> str:
        return messages[-1]["content"][: self.most] if messages else ""


@dataclass
class MarkingTranslator:
    """Marks a text with the language that is asked for."""

    def translate(self, text: str, language: str) -> str:
        return f"[{language}] {text}" if text.strip() else text


def embed(model: Embedder):
    """An Arrow-batched function from texts to vectors; the model is sent along (wrap a large one in `PerWorker`)."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.embed(texts.fillna("").tolist())))

    return run


def rerank_scores(model: Reranker):
    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(queries.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    return run


def extract_entities(model: EntityExtractor):
    @F.pandas_udf("array<struct<name:string,type:string,aliases:array<string>,confidence:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.extract(t or "") for t in texts])

    return run


def translate(model: Translator, language: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.translate(t, language) if t is not None else None)

    return run


#: Fixed values of extracted entities.
MOST_ENTITIES, CONFIDENCES = 12, ("high", "medium", "low")
ENTITIES = "array<struct<name:string,type:string,aliases:array<string>,confidence:string>>"


def entities_from_json(raw: Column) -> Column:
    """A model's answer as entities: the JSON array (or one object) in it, those with a name and a type, at most 12. Aliases that
    are no list are none; an unknown confidence is medium."""
    loose = "array<struct<name:string,type:string,aliases:string,confidence:string>>"
    array = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    single = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    starts = F.regexp_extract(raw, r"(?s)^[^\[{]*([\[{])", 1)
    found = F.coalesce(F.when(starts == "[", F.from_json(array, loose)), F.from_json(F.concat(F.lit("["), single, F.lit("]")), loose))
    named = F.filter(found, lambda e: (F.trim(F.coalesce(e["name"], F.lit(""))) != "") & (F.trim(F.coalesce(e["type"], F.lit(""))) != ""))
    none = F.array().cast("array<string>")
    shaped = F.transform(
        named,
        lambda e: F.struct(
            F.trim(e["name"]).alias("name"),
            F.trim(e["type"]).alias("type"),
            F.coalesce(F.from_json(e["aliases"], "array<string>"), none).alias("aliases"),
            F.when(F.lower(e["confidence"]).isin(*CONFIDENCES), F.lower(e["confidence"])).otherwise("medium").alias("confidence"),
        ),
    )
    return F.coalesce(F.slice(shaped, 1, MOST_ENTITIES), F.array().cast(ENTITIES))
