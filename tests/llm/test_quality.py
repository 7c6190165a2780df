from quarry.llm import quality, queries, sql
from quarry.staging import stage
from tests.compare import assert_same
from tests.llm import brute


def stats(text):
    w = brute.words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(5)} if len(w) < 5000 else None
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_query_agrees_with_sql(spark, sf_dir, duck):
    assert_same(queries.op10_quality(spark, sf_dir), duck, sql.OP10)


def test_awkward(awkward, no_docs):
    rows = quality.apply_verdicts(stage(quality.base_rules(awkward), "ruled")).collect()
    assert len(rows) == awkward.count() and rows[0]["size"] == "other"
    for r in rows:
        want = stats(r["text"])
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got[:4] == want[:4] and want[4] in (None, got[4])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
        assert r["kept"] == (not r["base_failed"] and r["host_rate"] <= quality.MAX_HOST_RATE)
    assert quality.apply_verdicts(stage(quality.base_rules(no_docs), "ruled")).count() == 0


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(200)] + [(1000 + i, good if i % 10 == 0 else bad, "farm") for i in range(200)] + [(2000, good, "tiny"), (2001, bad, "tiny")]
    out = quality.apply_verdicts(stage(quality.base_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")), "ruled")).collect()
    ok = {r["source"]: r["host_ok"] for r in out}
    assert ok["fine"] and not ok["farm"]
    rate = {r["source"]: r["host_rate"] for r in out}
    assert 0.1 <= rate["fine"] < 0.15 < rate["farm"]
