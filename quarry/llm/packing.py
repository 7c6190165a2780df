"""Operator 2, packing: shortest-pack-first over the length histogram.

Method: texts become token ids (ended by id 1) and are cut into pieces of at most ``size`` ids; the
histogram of piece lengths, at most ``size`` rows, is packed longest length first, each length going to
the packs with the least in them that it fits; what results is a table of packing patterns with counts;
pieces are joined to the patterns by their rank within their length.

Defined cases: a null or empty text is the closing id alone; rows that repeat a doc_id or lack one are
packed as rows of their own; further columns are not carried; an empty table gives no pieces.
"""

from __future__ import annotations

import os
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.staging import stage

SIZE = 2048
#: Words whose ids a Python worker keeps; a full memo is emptied, so its memory is bounded.
MEMO_ENTRIES = 150_000
#: Texts that are tokenised at a time.
SLICE = 1000
#: Pieces of one length that are numbered by one task, about: a length has as many buckets as that takes.
RANK_ROWS = 100_000

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file that drops white space and lower-cases: each distinct word is encoded once.

    A word of letters with punctuation behind it is two pre-tokens, so the two are encoded apart; words
    of letters are encoded many to a call and taken apart at the ids that end a word.  All other words
    go to the library one by one, and so does a call whose parts don't add up.
    """

    TAIL = ".,;:!?#$%&*|"
    JOINED = 200

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.lower = Tokenizer(self.full.model)  # for a-z nothing is left to normalise
        self.lower.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def _parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        parts, n = [], np.ones(len(words), dtype=np.int64)
        for i, word in enumerate(words):
            stem = word.rstrip(self.TAIL)
            # A letter whose normal or lower form has a mark would join the punctuation behind it.
            if stem.isalpha() and (stem.isascii() or (is_normalized("NFC", stem) and stem.lower().isalpha())):
                parts.append(stem.lower() if stem.isascii() else stem)
                if len(stem) < len(word):
                    parts.append(word[len(stem) :])
                    n[i] = 2
            else:
                parts.append(word)
        return parts, n

    def _alone(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.full.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, words: list[str], by, out: list[str], flat: list, size: list) -> None:
        calls = [words[k : k + self.JOINED] for k in range(0, len(words), self.JOINED)]
        for some, encoded in zip(calls, by.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                lens = np.diff(ends, prepend=-1)
            else:
                each = self._alone(some)
                ids, lens = np.array([i for e in each for i in e], dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64)
            out += some
            flat.append(ids)
            size.append(lens)

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words behind those in the memo."""
        lower, letters, odd = [], [], []
        for w in words:
            (odd if not w.isalpha() else lower if w.isascii() and w.islower() else letters).append(w)
        out: list[str] = []
        flat, size = [self.flat], [self.size]
        self._encode(lower, self.lower, out, flat, size)
        self._encode(letters, self.full, out, flat, size)
        each = self._alone(odd)
        out += odd
        flat.append(np.array([i for e in each for i in e], dtype=np.uint32))
        size.append(np.array([len(e) for e in each], dtype=np.int64))
        known = len(self.size)
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        self.memo.update(zip(out, range(known, len(self.size))))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and the number of ids of each word."""
        parts, n = self._parts(words)
        new = [w for w in dict.fromkeys(parts) if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self._forget()
            new = list(dict.fromkeys(parts))
        self._learn(new)
        rows = np.fromiter((self.memo[w] for w in parts), dtype=np.int64, count=len(parts))
        begin = np.cumsum(self.size) - self.size
        word = np.repeat(np.arange(len(n)), n)
        return _gather(self.flat, begin[rows], self.size[rows]), np.bincount(word, weights=self.size[rows], minlength=len(n)).astype(np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, size = self.words(coded.dictionary.to_pylist())
        lens = size[codes]
        doc = np.repeat(np.arange(len(n_words)), n_words)
        return _gather(flat, (np.cumsum(size) - size)[codes], lens), np.bincount(doc, weights=lens, minlength=len(n_words)).astype(np.int64)


def _gather(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that start at ``begin``, one after the other."""
    return flat[np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``size`` ids of every whole text: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens."""

    def cut(batches):
        try:
            yield from pieces(batches, _tokenizer(tokenizer_path))
        finally:  # a worker lives on: the next task in it, of whatever operator, finds the memory free
            _tokenizers.clear()
            pa.default_memory_pool().release_unused()

    def pieces(batches, tokenizer):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, counts = tokenizer.texts(part.column(1))
                ends = np.cumsum(counts)
                full = np.insert(ids, ends, end_id).astype("<u4")  # the closing id behind each text
                total = counts + 1
                first = np.cumsum(total) - total
                n = -(-total // size)
                doc = np.repeat(np.arange(len(n)), n)
                start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, total[doc] - start)
                raw, begin = full.tobytes(), (first[doc] + start) * 4
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(doc)),
                        pa.array(start, type=pa.int64()),
                        pa.array(length, type=pa.int64()),
                        pa.array([raw[b : b + k * 4] for b, k in zip(begin.tolist(), length.tolist())], type=pa.binary()),
                        pa.array(total[doc], type=pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (count, [(length, times), ...]) that use up the histogram {length: pieces}.

    Lengths go longest first, each to the packs with the least in them ("shortest pack first") that have
    room, whole groups of equal packs at a time; a pack takes a length as often as room and need allow.
    """
    groups: dict[int, list[tuple[int, tuple]]] = {}  # ids in the pack -> (count, pattern)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            filled = min((f for f in groups if f + length <= size), default=0)
            if filled == 0:
                times = min(left, size // length)
                times = 1 if left <= 1 or length * 2 > size else times
                count = left // times
                pattern: tuple = ()
            else:
                have, pattern = groups[filled].pop()
                times = min(max(1, left // have), (size - filled) // length)
                count = min(have, left)
                if have > count:
                    groups[filled].append((have - count, pattern))
                if not groups[filled]:
                    del groups[filled]
            groups.setdefault(filled + times * length, []).append((count, (*pattern, (length, times))))
            left -= count * times
    return [(count, list(pattern)) for filled in sorted(groups, reverse=True) for count, pattern in groups[filled]]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, times, first sequence, offset): which ranks of a length lie where."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = used.get(length, 0)
            used[length] = first + count * times
            rows.append((length, first, count * times, times, sequence, offset))
            offset += length * times
        sequence += count
    return rows


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (any columns, with a bigint ``length`` from 1 to ``size``) with sequence_id, offset, filled and padded_length.

    ``pieces`` should be staged: it is read twice.  The histogram and the pattern table have at
    most ``size`` and about 63 * 2 * ``size`` rows (a pack holds at most 63 different lengths of 2048),
    whatever the input, so they may pass through the driver and be broadcast.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = spark.createDataFrame([(length, -(-n // RANK_ROWS)) for length, n in histogram.items()], "length bigint, __buckets bigint")
    # written with their buckets, as equal rows are told apart by where they were read
    key = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns], F.monotonically_increasing_id()), F.col("__buckets")).cast("int")
    keyed = stage(pieces.join(F.broadcast(dealt), "length").select(*[F.col(f"`{c}`") for c in pieces.columns], key.alias("__bucket")), "pack-keyed")
    cells = stage(keyed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")), "pack-cells")
    patterns = pack_histogram(histogram, size)
    filled, first = [], 0
    for count, pattern in patterns:
        filled.append((first, first + count - 1, sum(k * t for k, t in pattern)))
        first += count
    total = {f: s for f, _, s in filled}
    rows = [(*r, total[r[4]]) for r in _slots(patterns)]
    schema = "length bigint, __first bigint, __ranks bigint, __times bigint, __seq bigint, __at bigint, filled bigint"
    slots = spark.createDataFrame(rows, schema)
    by_length = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("__first", "__ranks", "__times", "__seq", "__at", "filled"))).alias("__slots"))

    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # The numbering follows every column, so a repeated task numbers the rows alike.
    order = [F.col(f"`{c}`") for c in pieces.columns if c != "length"]
    within = Window.partitionBy("length", "__bucket").orderBy(*order)
    ranked = keyed.withColumn("__row", F.row_number().over(within)).join(offsets, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("__slot", _slot_of())
    slot, turn = F.col("__slot"), F.col("__rank") - F.col("__slot.__first")
    power = F.expr("filled > 0 and (filled & (filled - 1)) = 0")
    return placed.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (slot["__seq"] + F.floor(turn / slot["__times"])).cast("bigint").alias("sequence_id"),
        (slot["__at"] + F.pmod(turn, slot["__times"]) * F.col("length")).cast("bigint").alias("offset"),
        slot["filled"].alias("filled"),
    ).withColumn("padded_length", F.when(power, F.col("filled")).otherwise(F.lit(size).cast("bigint")))


def _slot_of():
    """The slot whose ranks hold ``__rank``: slots of a length follow each other without gaps."""
    return F.expr("filter(__slots, s -> s.__first <= __rank and __rank < s.__first + s.__ranks)[0]")
