from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns of other meaning that have the names of results and intermediate figures.
CLASHING = ("n_tokens", "n_bytes", "over_limit", "size", "source_size", "target", "copies", "passes", "below", "taken", "host_docs", "host_ok", "kept", "n_words", "base_failed", "lang_pred", "score", "held_out", "component_id", "n_chunks", "removed_chunks", "rank", "shard", "node", "length", "start", "label", "probability", "prediction", "e", "k", "x", "h", "no")

LINES = ["alpha beta gamma", "delta epsilon", "zeta eta theta iota", "kappa lambda", "mu nu xi omicron pi", "rho sigma tau", "upsilon phi", "chi psi omega"]
LONG = " ".join(f"Word{i % 997}x{i % 13}," for i in range(40_000)) + " " + "ab" * 10_000 + "\n" * 50 + "Ünïcödé — 漢字 " * 200


def awkward_rows() -> list[tuple]:
    block = "\n".join(LINES)
    return [
        (1, block, "en", "s1", 1),
        (1, block, "en", "s1", 1),  # the same row again
        (2, block, "en", None, 1),  # a copy
        (3, "new line\n" + block + "\nlast line", "en", "s2", 1),
        (4, None, None, "s2", None),
        (5, "", "fr", "s1", 0),
        (6, " \t\r\n\x0b\x0c ", "fr", "s3", 7),
        (7, LONG, "de", "s1", len(LONG)),
        (None, block, None, None, None),
        (None, None, None, None, None),
        (8, "one", "en", "s2", 3),
        (9, "one  two\u3000three \u2581 ▁▁ <s> </s> <unk> <|endoftext|> \x00 \u0301e", "en", "s2", 3),
        (9, "another text under the same id, with some more words in it", "en", "s2", 3),
        (10, "123 456 !!! ###", "en", "s4", 3),
        (11, "ça va très bien \U0001f600\U0001f600 ok", "fr", "s4", 3),
        (20, "ALPHA beta Gamma delta alpha BETA gamma delta alpha beta gamma", "en", "s1", 1),
        (40, block.upper(), "en", "s1", 1),
    ]


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing further columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
