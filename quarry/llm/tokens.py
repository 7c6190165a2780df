"""Operator 1, token counts: rank-synchronous array merging.

Method: each batch of texts is cut into pre-tokens that no merge crosses; the distinct pre-tokens of
the batch are held as ragged numpy arrays; each round applies every sequence's lowest-rank pair
simultaneously; the symbols that survive are counted and summed back to the texts.

Defined cases: a null or empty text has 0 tokens; repeated rows, null ids and further columns of any
name pass through; very long texts and very long runs without a space are counted whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import MergeTable

SPACE = "▁"
#: Pre-token counts that a Python worker keeps; a full memo is emptied, so its memory is bounded.
MEMO_ENTRIES = 400_000


class PieceCounter:
    """Counts the tokens of texts under one sentencepiece BPE model, with a bounded memo of pre-tokens."""

    def __init__(self, path: str):
        self.table = MergeTable.from_sentencepiece(path)
        self.memo: dict[str, int] = {}
        # Pieces hold the space mark only in front, so no merge crosses a word's end.
        for piece in self.table.symbols:
            if re.search(f"[^{SPACE}]{SPACE}", piece):
                raise ValueError("a piece has a space mark behind another character")
        if "\n" in self.table.joining:
            raise ValueError("a piece of several characters holds a line break")
        self.odd = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def units(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        new = [w for w in words if w not in memo]
        if new:
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = words
            counts = self.table.count(new)
            if len(new) > MEMO_ENTRIES:
                got = dict(zip(new, counts.tolist()))
                return np.fromiter((got[w] for w in words), dtype=np.int64, count=len(words))
            memo.update(zip(new, counts.tolist()))
        return np.fromiter((memo[w] for w in words), dtype=np.int64, count=len(words))

    def texts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.starts_with(texts, " "))
        total = np.zeros(len(texts), dtype=np.int64)
        slow = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if len(plain):
            total[plain] = self._plain(texts.take(pa.array(plain)))
        for i in slow:  # runs of spaces merge among themselves: cut by the pattern
            marked = SPACE + texts[int(i)].as_py().replace(" ", SPACE)
            total[i] = int(self.units(self.odd.findall(marked)).sum())
        return total

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Texts with single spaces only: split by lines, then by spaces, in Arrow."""
        lines = pc.split_pattern(texts, "\n")
        n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.split_pattern(lines.flatten(), " ")
        n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2
        first_line = np.cumsum(n_lines) - n_lines
        bare = np.ones(len(n_words), dtype=np.int64)
        bare[first_line] = 0  # a text's first line has the dummy space before it
        code[np.cumsum(n_words) - n_words] += bare
        names = coded.dictionary.to_pylist()
        per_code = np.zeros(2 * len(names), dtype=np.int64)
        per_code[code] = 1
        distinct = np.flatnonzero(per_code)
        per_code[distinct] = self.units([names[c >> 1] if c & 1 else SPACE + names[c >> 1] for c in distinct.tolist()])
        counts = per_code[code]
        doc = np.repeat(np.repeat(np.arange(len(n_lines)), n_lines), n_words)
        sums = np.bincount(doc, weights=counts, minlength=len(n_lines)).astype(np.int64)
        return sums + n_lines - 1  # a line break is one byte token


_counters: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with a column ``into``: the tokens of each whole text.  ``model_path`` must exist on every executor."""

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(model_path).texts(texts), type=pa.int64())

    return docs.withColumn(into, tokens(F.col(f"`{text}`").cast("string")))
