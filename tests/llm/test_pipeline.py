import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm import brute
from tests.llm.test_packing import check_sequences
from tests.llm.test_simhash import by_fingerprint


def table(df):
    return {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()}


def test_each_stage_on_what_its_predecessor_kept(spark, sf_dir, documents):
    docs = documents.select(*cp.COLUMNS)
    before = table(docs)
    after = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == cp.COLUMNS
        docs = spark.read.parquet(written(out, name))
        after[name] = docs
    letters = {i: r for i, r in before.items() if any(c.isalpha() for c in r[0] or "")}
    assert table(after["language"]) == letters

    cut = brute.dedup_lines([(i, r[0]) for i, r in letters.items()])
    want = {i: cut[i, r[0]] for i, r in letters.items()}
    want = {i: w[0] for i, w in want.items() if not w[2] or w[2] < w[1]}
    got = table(after["line_dedup"])
    assert {i: r[0] for i, r in got.items()} == want
    assert all(r[3] == len(r[0]) for i, r in got.items() if r[0] != letters[i][0])

    group = by_fingerprint({i: brute.fingerprint(t) for i, t in want.items()})
    kept = table(after["near_dedup"])
    assert set(kept) == set(group.values()) and all(kept[i] == got[i] for i in kept)

    mixed = after["mixing"].collect()
    copies: dict[int, int] = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        assert kept[r["doc_id"]][0] == r["text"]
    assert max(copies.values()) <= 2
    sizes: dict = {}
    for i, r in kept.items():
        sizes[r[2]] = sizes.get(r[2], 0) + len(brute.words(r[0]))
    for source, target in brute.targets(sizes).items():
        mine = [len(brute.words(kept[i][0])) * n for i, n in copies.items() if kept[i][2] == source]
        assert abs(sum(mine) - target) <= max(len(brute.words(r[0])) for r in kept.values() if r[2] == source)

    rows = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_sequences(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(cp.WORD_MODEL))
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)


def written(df, name):
    from quarry.staging import shared_dir

    path = f"{shared_dir(df.sparkSession)}/test-{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    check_sequences(rows)


def test_awkward(spark, awkward, no_docs, sf_dir):
    for name, stage in cp.STAGES:
        for docs in (awkward, no_docs):
            out = stage(spark, docs, sf_dir)
            n = out.count()
            assert n == 0 if docs is no_docs else n > 0, name
    near = dict(cp.STAGES)["near_dedup"](spark, awkward, sf_dir).collect()
    assert [r["doc_id"] for r in near].count(1) == 1 and 2 not in {r["doc_id"] for r in near}


def test_language_rejects_and_labels(spark, documents, sf_dir):
    """Clean documents stay, and what the profiles say of others decides."""
    docs = documents.select(*cp.COLUMNS)
    odd = [(-1, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440, \u044d\u0442\u043e \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442"), (-2, "123 !!"), (-3, None)]
    french = [(-10 - i, r["text"]) for i, r in enumerate(documents.where("lang = 'fr'").limit(20).collect())]
    rows = spark.createDataFrame([(i, t, None, "s", 1) for i, t in odd + french], docs.schema)
    kept = {r["doc_id"]: r for r in cp.identify_language(spark, docs.union(rows), sf_dir).collect()}
    assert {r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()} <= set(kept)
    assert not {-1, -2, -3} & set(kept)
    assert sum(kept[i]["lang"] == "fr" for i, _ in french) >= 19
    assert all(kept[r["doc_id"]]["lang"] == r["lang"] for r in docs.collect() if r["doc_id"] in kept)
    unlabelled = cp.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")).union(rows), sf_dir)
    assert -1 in {r["doc_id"] for r in unlabelled.collect()} and not {-2, -3} & {r["doc_id"] for r in unlabelled.collect()}
