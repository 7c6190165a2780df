import random

import pytest

from quarry.llm import mixing, queries
from quarry.staging import stage
from tests.llm import brute


def check(rows):
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute.targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in rows if r["source"] == source]
        assert all(r["source_size"] == size and abs(r["target"] - want[source]) < 1e-6 * max(1, size) for r in mine)
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - want[source]) <= max((r["size"] for r in mine), default=0)
        assert all(0 <= r["copies"] <= 2 for r in mine)


def test_query(spark, sf_dir, documents):
    rows = queries.op6_mixing(spark, sf_dir).collect()
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in documents.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == size and all(r["taken"] == r["copies"] * r["size"] for r in rows)
    check(rows)
    assert {tuple(r) for r in rows} == {tuple(r) for r in queries.op6_mixing(spark, sf_dir).collect()}


def test_awkward(awkward, no_docs):
    rows = mixing.mix(stage(mixing.size_documents(awkward), "sized")).collect()
    assert len(rows) == awkward.count()
    assert all(r["size"] == len(brute.words(r["text"])) and r["passes"] == "other" and r["below"] == "other" for r in rows)
    alike = {}
    for r in rows:
        alike.setdefault((r["doc_id"], r["text"]), set()).add(r["copies"])
    assert all(len(v) == 1 for v in alike.values())
    assert mixing.mix(stage(mixing.size_documents(no_docs), "sized")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_targets_and_hot_source(spark, seed):
    draw = random.Random(seed)
    sources = [None, *[f"s{i}" for i in range(draw.randrange(1, 9))]]
    rows = [(i, " ".join(["w"] * draw.randrange(0, 60)), draw.choice(sources) if i % 3 else sources[-1]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(mixing.mix(stage(mixing.size_documents(df), "sized")).collect())


def test_all_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    rows = mixing.mix(stage(mixing.size_documents(df), "sized")).collect()
    assert len(rows) == 2 and all(r["copies"] == 0 and r["target"] == 0 for r in rows)
