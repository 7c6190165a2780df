"""Operator 10, quality rules: host-level rules.

Method: each document is held against base rules; failures are summed by host (``source``); a host's
failure rate is shrunk towards the rate of all hosts by an empirical beta prior, fitted by moments; hosts
whose shrunk rate is too high are rejected, and the verdict is joined back to their documents.

Defined cases: a null text has no words and fails; a null source is a host of its own; with one host, or
hosts that do not differ, the prior is as strong as all their documents; an empty table gives no rows;
repeated rows count as often as they occur; further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host goes if more than this share of its documents is expected to fail.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each text, its words that lie in a ``WINDOW``-word window found twice or more in that text.

    ``codes`` are word numbers, ``doc`` the text of each.  Windows are sorted by a hash and neighbours of
    equal hash compared word by word; texts in which a hash joins unlike windows are counted by the words.
    """
    out = np.zeros(n_docs, dtype=np.int64)
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return out
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    h = _mixed(doc[at].astype(np.uint64))
    for k in range(WINDOW):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    same = h[1:] == h[:-1]
    a, b = at[1:][same], at[:-1][same]
    alike = doc[a] == doc[b]
    for k in range(WINDOW):
        alike &= codes[a + k] == codes[b + k]
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    found = np.unique(np.concatenate((a, b)))
    np.add.at(covered, found, 1)
    np.add.at(covered, found + WINDOW, -1) if len(found) else None
    hit = np.cumsum(covered)[:-1] > 0
    out += np.bincount(doc[hit], minlength=n_docs)
    for d in np.unique(np.concatenate((doc[a[~alike]], doc[b[~alike]]))):
        words = codes[doc == d].tolist()
        windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        out[d] = len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(WINDOW)})
    return out


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base figures of each whole text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten()
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), per_text)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = chars > 0  # white space at an end leaves an empty part
    codes, doc, chars = codes[real], doc[real], chars[real]

    split = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    lines = split.flatten()
    with_word = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    line_code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[with_word]
    line_doc = line_doc[with_word]
    distinct = np.unique((line_doc << 32) | line_code) >> 32  # a batch has fewer than 2 ** 31 lines
    symbols = sum(pc.count_substring(texts, s).to_numpy(zero_copy_only=False).astype(np.int64) for s in SYMBOLS)
    return {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": np.bincount(doc, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": symbols,
        "n_dup_lines": (np.bincount(line_doc, minlength=n) - np.bincount(distinct, minlength=n)).astype(np.int64),
        "n_repeat_words": repeated_words(codes, doc, n),
    }


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base figures and base_failed."""

    @F.arrow_udf("struct<" + ", ".join(f"{s}: bigint" for s in _STATS) + ">")
    def stats(texts: pa.Array) -> pa.Array:
        parts = [text_stats(texts.slice(k, 2000)) for k in range(0, len(texts), 2000)]
        got = [np.concatenate([p[s] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for s in _STATS]
        return pa.StructArray.from_arrays([pa.array(g, type=pa.int64()) for g in got], names=list(_STATS))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*_STATS, "base_failed")]
    figured = docs.select(*kept, stats(F.col(f"`{text}`").cast("string")).alias("__s"))
    out = figured.select(*kept, *[F.col(f"__s.{s}").alias(s) for s in _STATS])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(ruled: DataFrame, max_rate: float = MAX_HOST_RATE, host: str = "source") -> DataFrame:
    """One row for each host: host_docs, host_failures, host_rate (shrunk) and host_ok."""
    hosts = ruled.groupBy(F.col(f"`{host}`").alias("__host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    # Moments of the hosts' rates, each host weighing by its documents; sampling noise m(1-m)/n is taken off the variance.
    m = hosts.agg(
        F.sum("host_docs").alias("docs"), F.sum("host_failures").alias("failures"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("host_docs") * rate * rate).alias("squares")
    ).withColumn("mean", F.try_divide("failures", "docs"))
    noise = F.col("mean") * (1 - F.col("mean"))
    between = F.try_divide("squares", "docs") - F.col("mean") * F.col("mean") - F.try_divide(noise * F.col("hosts"), F.col("docs"))
    strength = F.when(between > 0, F.least(noise / between - 1, F.col("docs").cast("double"))).otherwise(F.col("docs").cast("double"))
    prior = m.select("mean", F.greatest(strength, F.lit(1.0)).alias("strength")).first()  # one row
    mean, weight = float(prior["mean"] or 0.0), float(prior["strength"] or 1.0)
    shrunk = (F.col("host_failures") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_ok", F.col("host_rate") <= max_rate)


def apply_verdicts(ruled: DataFrame, max_rate: float = MAX_HOST_RATE, host: str = "source") -> DataFrame:
    """``ruled`` (from ``base_rules``, staged, as it is read twice) with the host's figures and kept."""
    ruled = ruled.drop("host_docs", "host_failures", "host_rate", "host_ok", "kept")
    verdicts = host_verdicts(ruled, max_rate, host)
    joined = ruled.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
