import random

import numpy as np
import pytest

from quarry.llm import queries, simhash
from quarry.staging import stage
from tests.llm import brute


def by_fingerprint(prints: dict):
    """component of each id from its fingerprint."""
    least = {}
    for i, f in prints.items():
        least[f] = min(least.get(f, i), i)
    roots = brute.components(sorted(least, key=least.get), lambda a, b: (a ^ b).bit_count() <= 3)
    group: dict[int, int] = {}
    for f, r in roots.items():
        group[r] = min(group.get(r, least[f]), least[f])
    return {i: group[roots[f]] for i, f in prints.items()}


def test_query(spark, sf_dir, documents):
    prints = {r["doc_id"]: brute.fingerprint(r["text"]) for r in documents.collect()}
    want = by_fingerprint(prints)
    rows = queries.op3_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", want[i]) for i, f in prints.items()}
    assert len({r["component_id"] for r in rows}) < len(rows)


def test_awkward(awkward, no_docs):
    printed = stage(simhash.with_fingerprint(awkward), "printed")
    rows = simhash.near_duplicates(printed).collect()
    assert len(rows) == awkward.count()
    assert all(simhash.fingerprint(r["text"]) % (1 << 64) == brute.fingerprint(r["text"]) for r in rows)
    group = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] not in (None, 9)}
    assert group[1] == group[2] == group[40] == 1 and group[4] == group[5] == group[6] == 4
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1, 4}
    assert rows[0]["rank"] == "other"
    assert simhash.near_duplicates(stage(simhash.with_fingerprint(no_docs), "printed")).count() == 0


@pytest.mark.parametrize(("leaf", "block"), [(1000, 16_384), (20, 16_384), (10_000, 37)])
def test_trees_lose_no_pair(spark, leaf, block):
    draw = random.Random(3)
    prints: dict[int, int] = {}
    for c in range(150):
        base = draw.getrandbits(64) if c % 3 else draw.getrandbits(10)
        for _ in range(draw.randrange(1, 6)):
            flips = draw.sample(range(64), draw.randrange(0, 4))
            base ^= sum(1 << b for b in flips) if draw.random() < 0.7 else 0
            prints[len(prints)] = base ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 4)))
    df = stage(spark.createDataFrame([(i, brute.signed(f)) for i, f in prints.items()], "doc_id bigint, fp bigint"), "prints")
    want = by_fingerprint(prints)
    found = simhash.links(df.groupBy("fp").count().select("fp"), leaf=leaf, block=block).collect()
    least = {}
    for i, f in prints.items():
        least.setdefault(f, i)
    linked = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in found}
    roots = brute.components(sorted(least), lambda a, b: frozenset((a, b)) in linked)
    assert len(set(roots.values())) == len(set(want.values()))


def test_route_reaches_every_partner():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 1 << 32, 3000, dtype=np.uint32)
    tree = simhash.build_tree(points, 50)
    at, leaf, own = simhash.route(points, tree)
    assert sorted(at[own].tolist()) == list(range(3000))
    near = points ^ np.uint32(1) << rng.integers(0, 32, 3000).astype(np.uint32)
    at2, leaf2, own2 = simhash.route(near, tree)
    home = dict(zip(at[own].tolist(), leaf[own].tolist()))
    visits = set(zip(at2.tolist(), leaf2.tolist()))
    assert all((i, home[i]) in visits for i in range(3000))
