import zlib
from collections import Counter

from quarry.llm import language, queries
from tests.llm import brute


def test_query(spark, sf_dir, documents):
    docs = documents.collect()
    rows = {r["doc_id"]: r for r in queries.op9_language(spark, sf_dir).collect()}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs}
    assert {i: r["held_out"] for i, r in rows.items()} == held
    counts: dict[str, Counter] = {}
    for r in docs:
        if not held[r["doc_id"]] and r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update(brute.grams(r["text"] or ""))
    profiles = {k: brute.profile(c, language.TOP) for k, c in counts.items()}
    for r in docs:
        own = brute.profile(brute.grams(r["text"]), language.TOP)
        away = {k: brute.out_of_place(own, p, language.TOP) for k, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert rows[r["doc_id"]]["lang_pred"] == (best if own else "und")
        assert abs(rows[r["doc_id"]]["score"] - (1 - away[best] / (language.TOP * len(own)) if own else 0)) < 1e-12
    tested = [r for r in docs if held[r["doc_id"]] and r["lang"] is not None]
    assert sum(rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_awkward(awkward, no_docs):
    profiles = language.train_profiles(awkward)
    assert sorted(profiles) == ["de", "en", "fr"]
    rows = language.identify(awkward, profiles).collect()
    assert len(rows) == awkward.count() and rows[0]["kept"] == "other"
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language.train_profiles(no_docs) == {}
    assert {r["lang_pred"] for r in language.identify(awkward, {}).collect()} == {"und"}
    assert language.identify(no_docs, profiles).count() == 0


def test_ties_go_to_the_first_language():
    model = language.Profiles({"b": [97, 98], "a": [97, 98]})
    assert model.predict("ab")[0] == "a"


def test_slices_change_nothing(documents, monkeypatch):
    whole = language.train_profiles(documents)
    monkeypatch.setattr(language, "SLICE", 7)
    assert language.train_profiles(documents) == whole
