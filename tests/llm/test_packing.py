import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing, queries
from quarry.staging import stage

PATH = public_tokenizers.path("word_bpe_49k.json")
SIZE = packing.SIZE


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(rows, want: dict, most_waste: float = 0.05):
    """Every id of every document in one piece; sequences without gaps; little padding."""
    for doc, ids in want.items():
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == list(np.cumsum([0, *[r["length"] for r in mine[:-1]]]))
        assert sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
    check_sequences(rows, most_waste)


def check_sequences(rows, most_waste: float = 0.05):
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_length"]))
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= SIZE
        assert pieces[0][2] == (at if at & (at - 1) == 0 else SIZE)
        padded += pieces[0][2]
    total = sum(r["length"] for r in rows)
    assert padded <= total * (1 + most_waste) + SIZE
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_query(spark, sf_dir, documents, library):
    rows = queries.op2_packing(spark, sf_dir).collect()
    check_packed(rows, {r["doc_id"]: library(r["text"]) for r in documents.collect()})
    again = queries.op2_packing(spark, sf_dir).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_awkward(awkward, no_docs, library):
    def packed(df):
        pieces = packing.token_pieces(df, PATH).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
        return packing.pack(stage(pieces, "pieces")).collect()

    texts = {r["doc_id"]: r["text"] for r in awkward.collect() if r["doc_id"] not in (None, 1, 9)}
    rows = packed(awkward)
    for doc, text in texts.items():  # pieces follow each other, hold all ids, and each as the library gives it
        ids, at = library(text), 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in rows) == sum(len(library(r["text"])) for r in awkward.collect())
    check_sequences(rows, 9.0)
    assert packed(no_docs) == []


def test_lengths_of_many_equal_pieces(spark, monkeypatch):
    """Equal rows are dealt to several buckets, and every piece has a place of its own."""
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    pieces = spark.range(400).selectExpr("cast(null as bigint) as doc_id", "cast(0 as bigint) as start", "if(id < 300, 1, 2048) as length").withColumn("length", F.col("length").cast("bigint"))
    rows = packing.pack(stage(pieces, "pieces")).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(rows) == len(places) == 400 and max(r["offset"] for r in rows) < 2048
    assert len({r["sequence_id"] for r in rows}) == 101


@pytest.mark.parametrize("seed", range(5))
def test_histogram_is_used_up(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, SIZE + 1, 3000) if seed else np.full(1000, SIZE // 3)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    patterns = packing.pack_histogram(histogram)
    used: dict[int, int] = {}
    for count, pattern in patterns:
        assert sum(k * t for k, t in pattern) <= SIZE
        for k, t in pattern:
            used[k] = used.get(k, 0) + count * t
    assert used == histogram
    assert sum(c for c, _ in patterns) <= lengths.sum() / SIZE * 1.06 + 1
