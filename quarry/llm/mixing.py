"""Operator 6, mixing sources to target weights: hash-threshold histograms.

Method: every document has a hash; its sizes are summed by source and hash bucket; along the buckets the
budget of a source ends in one boundary bucket, which alone is refined, level by level, until it holds
one hash; then a document is taken once more than its source's whole passes if its hash lies below the
threshold.  No rows are sorted, and nothing but the thresholds depends on other rows.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; an empty table
gives an empty mix; documents that agree in id and text share a hash, so they are taken alike; further
columns pass through (names of the form ``__...`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.staging import stage

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Bits of the hash that each level of the histogram looks at, and its levels.
BITS, LEVELS = 12, 5


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``__place``, the number from 0 of each source in order: by ranges, so that no task orders them all."""
    ranged = stage(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())) - 1
    offsets = counts.select(F.col("__part").alias("__p"), before.alias("__before"))
    return ranged.join(offsets, F.col("__part") == F.col("__p")).withColumn("__place", within + F.col("__before")).drop("__part", "__p", "__before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Target of each source from ``sizes`` (source, source_size: one row for each source).

    Sources by code point, null last, weigh ``weights`` in turn and share ``total_share`` of all sizes; a
    target stops at ``max_epochs`` times its source's size and the excess is shared again by weight.
    So a target is min(cap, level * weight), and each round finds the level left by the sources at their cap.
    """
    weighed = _numbered(sizes).withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("__place", F.lit(len(weights))) + 1).cast("int"))).drop("__place")
    weighed = stage(weighed.withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))), "mix-sources")
    level, capped = 0.0, -1
    while True:
        at_cap = F.col("__cap") <= F.lit(level) * F.col("__weight")
        row = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(at_cap, F.col("__cap")).otherwise(F.lit(0.0))).alias("given"),
            F.sum(F.when(at_cap, F.lit(0.0)).otherwise(F.col("__weight"))).alias("open"),
            F.sum(at_cap.cast("int")).alias("n"),
        ).first()
        if row["total"] is None or row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (float(row["total"]) * total_share - row["given"]) / row["open"]
    return weighed.select("source", "source_size", F.least(F.col("__cap"), F.lit(level) * F.col("__weight")).alias("target"))


def _thresholds(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source: whole passes, and the hash below which documents are taken once more."""
    sized = F.col("source_size") > 0
    passes = F.when(sized, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = sources.withColumn("passes", passes)
    state = state.withColumn("__left", F.when(sized, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0.0)))
    state = state.withColumn("below", F.lit(0).cast("bigint"))
    rows = docs.where("size > 0").select(F.col("source").alias("__s"), "size", "__hash")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        width = 1 << shift
        bucket = F.shiftrightunsigned("__hash", shift)
        if level > 1:  # only what lies in the boundary bucket
            rows = rows.join(state.select(F.col("source").alias("__t"), F.col("below").alias("__from")), F.col("__s").eqNullSafe(F.col("__t")))
            rows = rows.where((F.col("__hash") >= F.col("__from")) & (F.col("__hash") < F.col("__from") + F.lit(width << BITS))).drop("__t", "__from")
        cells = rows.groupBy("__s", bucket.alias("__bucket")).agg(F.sum("size").alias("__sum"), F.count(F.lit(1)).alias("__n"))
        upto = F.sum("__sum").over(Window.partitionBy("__s").orderBy("__bucket"))  # at most 2 ** BITS rows a source
        cells = cells.withColumn("__upto", upto).join(state, F.col("__s").eqNullSafe(F.col("source")))
        # the boundary bucket: the first whose sum goes beyond what is left
        beyond = cells.where(F.col("__upto") > F.col("__left"))
        edge = beyond.groupBy("__s").agg(F.min_by(F.struct("__bucket", "__upto", "__sum", "__n"), F.col("__bucket")).alias("__e"))
        joined = state.join(edge, F.col("source").eqNullSafe(F.col("__s")), "left")
        found = F.col("__e").isNotNull()
        joined = joined.withColumn("__was", F.col("below"))
        state = joined.select(
            "source", "source_size", "target", "passes",
            F.when(found, F.col("__left") - (F.col("__e.__upto") - F.col("__e.__sum"))).otherwise(F.col("__left")).alias("__left"),
            F.when(found, F.col("__e.__bucket") * F.lit(width)).otherwise(F.lit(1 << (BITS * LEVELS)) if level == 1 else F.col("__was")).cast("bigint").alias("below"),
            F.when(found, F.col("__e.__sum")).otherwise(F.lit(0)).cast("bigint").alias("__edge"),
            F.coalesce(F.col("__e.__n"), F.lit(0)).alias("__edge_rows"),
        )
        state = stage(state, f"mix-level{level}")
        if not state.where("__edge_rows > 1").limit(1).count():
            break
        if level < LEVELS:
            state = state.drop("__edge", "__edge_rows")
    # what is left at the last boundary is taken whole where that comes nearer to the target
    whole = F.col("__edge") - F.col("__left") < F.col("__left")
    return state.select("source", "source_size", "target", "passes", F.when(whole, F.col("below") + F.lit(width)).otherwise(F.col("below")).alias("below"))


def size_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` with size, the words of the text, and ``__hash``, which decides what is taken."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 64 - BITS * LEVELS)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    return docs.select(*keep, size.alias("size"), hashed.alias("__hash"))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What ``size_documents`` returned, with source_size, target and copies: how often the mix takes each document."""
    light = stage(sized.select("source", "size", "__hash"), "mix-sizes")
    sources = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, max_epochs)
    cuts = _thresholds(light, sources).withColumnsRenamed({"source": "__source", "passes": "__passes", "below": "__below"})
    out = sized.drop("source_size", "target").join(cuts, F.col("source").eqNullSafe(F.col("__source")), "left")
    copies = F.when(F.col("size") > 0, F.col("__passes") + (F.col("__hash") < F.col("__below")).cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    copies = F.least(copies, F.lit(max_epochs).cast("bigint"))
    keep = [F.col(f"`{c}`") for c in sized.columns if c not in ("size", "__hash", "source_size", "target", "copies")]
    return out.select(*keep, "size", "source_size", "target", copies.alias("copies"))
