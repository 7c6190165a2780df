"""Operator 9, language ID: rank-order profiles.

Method: the profile of a language is the list of its most frequent character n-grams (1 to 3 letters or
word ends) over all training documents; a document's own list is compared to each profile by the
out-of-place distance, the sum of the differences in rank, an n-gram missing from a profile counting the
most; the nearest profile wins.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a language do
not train; without any training row every text is ``und``; equal distances go to the first language by
code point; repeated rows and further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: N-grams in a profile and in a document's list, at most.
TOP = 300
UNKNOWN = "und"
#: Texts whose n-grams are counted at a time.
SLICE = 250
_GAP = 32  # stands for everything that is not a letter

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def gram_codes(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text's words with a gap around each; 21 bits a character, empty if there is no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    points = np.where(letter, points, _GAP).astype(np.int64)
    p = points[np.append(True, letter[1:] | letter[:-1])]  # one gap between words
    two = (p[:-1] << 21) | p[1:]
    three = (two[:-1] << 21) | p[2:]
    return np.concatenate((p[p != _GAP], two, three[(p[1:-1] != _GAP)]))


def top_codes(codes: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes, most frequent first, equal counts by code."""
    distinct, counts = np.unique(codes, return_counts=True)
    return distinct[np.argsort(-counts, kind="stable")[:top]]


def train_profiles(labelled: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """Profiles by language from ``labelled`` (lang, text).  They hold ``top`` codes a language and so may pass through the driver."""

    def count(batches):
        for batch in batches:
            parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for at in range(0, batch.num_rows, SLICE):  # the codes of a slice are held at a time
                part = batch.slice(at, SLICE)
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                texts = part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    codes = [gram_codes(texts[i]) for i in np.flatnonzero(langs == lang)]
                    parts.setdefault(lang, []).append(np.unique(np.concatenate(codes), return_counts=True))
            for lang, counted in parts.items():
                distinct, at = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([n for _, n in counted]), minlength=len(distinct)).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(distinct), type=pa.string()), pa.array(distinct, type=pa.int64()), pa.array(counts)], names=["lang", "code", "n"])

    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = rows.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("place", place).where(F.col("place") <= top)
    profiles: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "place", "code").collect()):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Profiles:
    """Ranks of every profile's codes, side by side."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([np.array(profiles[k], dtype=np.int64) for k in self.langs] or [np.zeros(0, dtype=np.int64)]))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 for a distance of nothing, 0 for one as large as can be."""
        own = top_codes(gram_codes(text or ""), self.top)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own) if len(self.codes) else np.zeros(len(own), dtype=np.int64)
        at = np.minimum(at, len(self.codes) - 1)
        ranks = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        away = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), self.top)
        distance = away.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.top * len(own)))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text alone."""
    model = Profiles(profiles)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t) for at in range(0, len(texts), SLICE) for t in texts.slice(at, SLICE).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())], names=["lang_pred", "score"])

    predict = predict.asNondeterministic()  # it is not: but a filter on what it gives must not evaluate it again
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    guessed = docs.select(*kept, predict(F.col(f"`{text}`").cast("string")).alias("__p"))
    return guessed.select(*kept, F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))
