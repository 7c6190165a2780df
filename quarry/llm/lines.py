"""Operator 8, line deduplication: content-defined chunks of lines.  DataFrame functions only.

Method: every line has a hash; a hash that is the largest of the three in a window rolled over the line
hashes ends a chunk there, and a stretch of four lines or more between two such places is cut into twos
from its start, so boundaries move with the content and a chunk has two or three lines (one only where the
document has one).  The hashes of the chunks are counted over all documents; the texts of those met more
than once are grouped by their bytes, and all but the first occurrence (by doc_id, then place) are removed.
What stays of a repeated passage are lines at its edges whose chunk reaches beyond it.

Defined cases: a null text stays null; an empty text is one empty line; rows that agree in doc_id and
text are one document and stay alike; null ids come first; an empty table gives no rows; further columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.staging import stage

#: A repeated chunk of fewer lines stays: these are the documents of a single line.
MIN_LINES = 2


def _with_key(docs: DataFrame, text: str, doc_id: str, columns: list[str]) -> DataFrame:
    """``docs`` as key, text and, out of the way of any name, a struct of all other columns."""
    body, rest = F.col(f"`{text}`"), [F.col(f"`{c}`") for c in columns if c != text]
    return docs.select(F.col(f"`{doc_id}`").alias("__id"), F.xxhash64(body).alias("__h1"), F.xxhash64(body, F.lit(1)).alias("__h2"), body.alias("__text"), F.struct(*rest).alias("__rest"))


def _with_ends(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__hashes`` of the lines and ``__ends``, the number of the last line of each chunk."""
    hashes = F.transform(F.split(F.coalesce(F.col("__text"), F.lit("")), "\n", -1), lambda line: F.xxhash64(line))
    peaks = """filter(sequence(1, size(__hashes)), i -> i = size(__hashes) or
        (i between 2 and size(__hashes) - 2 and __hashes[i - 1] > __hashes[i - 2] and __hashes[i - 1] > __hashes[i]))"""
    twos = """flatten(transform(__peaks, (e, k) -> transform(array(e - if(k = 0, 0, __peaks[k - 1])), n ->
        if(n < 4, array(e), concat(sequence(e - n + 2, e - 2 - n % 2, 2), array(e))))[0]))"""
    return docs.withColumn("__hashes", hashes).withColumn("__peaks", F.expr(peaks)).withColumn("__ends", F.expr(twos)).drop("__peaks")


def _exploded(docs: DataFrame, chunk: str, name: str, *keep: str) -> DataFrame:
    """A row for each chunk; ``chunk`` is an expression of its number k, first line and lines.

    No array of chunks is empty, so the outer form is the same; unlike the inner one it isn't evaluated
    twice, once to filter empty arrays.
    """
    chunks = f"transform(__ends, (e, k) -> transform(array(struct(k as no, if(k = 0, 1, __ends[k - 1] + 1) as first)), x -> {chunk})[0])"
    return docs.select(*keep, F.explode_outer(F.expr(chunks)).alias(name))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, n_chunks, removed_chunks and removed_lines.

    Texts are shuffled once, to meet what is known of their chunks; after that only those of documents
    with a chunk of a repeated hash move again.
    """
    own = ("n_chunks", "removed_chunks", "removed_lines")
    columns = [c for c in docs.columns if c not in own]
    keyed = _with_key(docs, text, doc_id, columns)
    key = ["__id", "__h1", "__h2"]

    # 1. chunks by hash, without their texts
    lean = _with_ends(keyed.select(*key, "__text"))
    hashed = "named_struct('no', x.no, 'lines', e - x.first + 1, 'h', xxhash64(slice(__hashes, x.first, e - x.first + 1)))"
    chunks = stage(_exploded(lean, hashed, "__c", *key).select(*key, "__c.no", "__c.lines", "__c.h"), "chunks")

    # 2. the chunks of each document whose hash occurs again: numbers, bounded by the document
    again = chunks.where(F.col("lines") >= min_lines).groupBy("h", "lines").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    # (written, so that the join has plain shuffles on both sides, of which Spark splits what a hot chunk makes large)
    again = stage(again.select(F.col("h").alias("__h"), F.col("lines").alias("__l")), "repeated-hashes")
    suspect = chunks.join(again, (F.col("h") == F.col("__h")) & (F.col("lines") == F.col("__l")), "left")
    known = suspect.groupBy(*key).agg((F.max("no") + 1).alias("__chunks"), F.collect_set(F.when(F.col("__h").isNotNull(), F.col("no"))).alias("__nos"))
    marked = stage(_join_docs(keyed, known, key, "left"), "marked")

    # 3. the bytes of those chunks
    suspects = marked.where(F.size("__nos") > 0)
    cut_up = _with_ends(suspects.withColumn("__lines", F.split("__text", "\n", -1)))
    bytes_of = "if(array_contains(__nos, x.no), named_struct('no', x.no, 't', array_join(slice(__lines, x.first, e - x.first + 1), '\n')), null)"
    theirs = _exploded(cut_up, bytes_of, "__c", *key, "__nos", "__lines").where("__c is not null")
    theirs = theirs.select(F.struct(*key, F.col("__c.no").alias("no")).alias("__at"), F.col("__c.t").alias("__t"), F.xxhash64("__c.t").alias("__h"))
    first = theirs.groupBy("__h", "__t").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    gone = theirs.join(stage(first, "first-chunks"), ["__h", "__t"]).where("not (__at <=> __first)")
    gone = gone.groupBy("__at.__id", "__at.__h1", "__at.__h2").agg(F.collect_set("__at.no").alias("__gone"))

    # 4. what is left of the documents
    out = _join_docs(suspects, gone, key, "left").withColumn("__gone", F.coalesce("__gone", F.expr("cast(array() as array<int>)")))
    out = _with_ends(out.withColumn("__lines", F.split("__text", "\n", -1)))
    stays = "filter(transform(__ends, (e, k) -> named_struct('no', k, 'first', if(k = 0, 1, __ends[k - 1] + 1), 'last', e)), x -> not array_contains(__gone, x.no))"
    out = out.withColumn("__stays", F.expr(stays))
    kept = F.expr("array_join(transform(__stays, x -> array_join(slice(__lines, x.first, x.last - x.first + 1), '\n')), '\n')")
    cut = F.when(F.size("__gone") > 0, kept).otherwise(F.col("__text"))
    lost = F.expr("cast(size(__lines) - aggregate(__stays, 0, (s, x) -> s + x.last - x.first + 1) as bigint)")

    def shaped(rows: DataFrame, body: Column, removed_chunks: Column, removed_lines: Column) -> DataFrame:
        figures = (F.col("__chunks").cast("bigint").alias("n_chunks"), removed_chunks.cast("bigint").alias("removed_chunks"), removed_lines.alias("removed_lines"))
        return rows.select(*[body.alias(c) if c == text else F.col("__rest").getField(c).alias(c) for c in columns], *figures)

    none = F.lit(0).cast("bigint")
    untouched = marked.where("coalesce(size(__nos), 0) <= 0")
    return shaped(untouched, F.col("__text"), none, none).union(shaped(out, cut, F.size("__gone"), lost))


def _join_docs(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join in which a null id equals a null id."""
    other = right.select(*[F.col(c).alias(f"{c}r") if c in on else F.col(c) for c in right.columns])
    same = F.col("__id").eqNullSafe(F.col("__idr")) & (F.col("__h1") == F.col("__h1r")) & (F.col("__h2") == F.col("__h2r"))
    return left.join(other, same, how).drop(*[f"{c}r" for c in on])
