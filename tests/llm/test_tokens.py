import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from quarry.llm import queries, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(model.encode(text or "", num_threads=1))


def test_query_counts_as_the_library(spark, sf_dir, documents, library):
    got = {r["doc_id"]: r for r in queries.op1_token_counts(spark, sf_dir).collect()}
    for r in documents.collect():
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_tokens"]) == (len(r["text"].encode()), library(r["text"]))
        assert g["over_limit"] == (g["n_tokens"] > 4096)


def test_awkward(awkward, no_docs, library):
    rows = tokens.count_tokens(awkward, MODEL).collect()
    assert len(rows) == awkward.count() and all(r["n_tokens"] == library(r["text"]) for r in rows)
    assert rows[0]["kept"] == "other"
    assert tokens.count_tokens(no_docs, MODEL).count() == 0


def test_random_texts(library):
    draw = random.Random(5)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "ß", "漢", "\U0001f600", "<s>", "<0x41>", "1", "!!", "\u0301", "\xa0", "Zu"]
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(60))) for _ in range(1500)] + ["a" * 3000, " " * 500, "ab" * 2000 + "\n" * 300]
    counted = tokens.PieceCounter(MODEL).texts(pa.array(texts))
    assert counted.tolist() == [library(t) for t in texts]


def test_long_runs_without_a_space(library):
    """Runs of any length are merged in the same arrays: equal to the library, and in a bounded time."""
    draw = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(draw.choices(some, k=k)) for some in (letters, "ACGT", "ab", "aA", "01", "=-", "theing", "漢字仮名éß") for k in (255, 257, 3000)]
    texts += ["ab" * 50_000, "x" * 100_001, "".join(draw.choices(letters, k=100_000)), "abcabd" * 3000, "inging" * 999 + "x" + "hethe" * 999]
    began = time.perf_counter()
    counted = tokens.PieceCounter(MODEL).texts(pa.array(texts)).tolist()
    assert time.perf_counter() - began < 60
    assert counted == [library(t) for t in texts]
