"""The corpus pipeline: five stages, each one operator, from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language, lines, mixing, packing, simhash
from quarry.sources.tables import table
from quarry.staging import only_result_staged, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD_MODEL = "word_bpe_49k.json"
#: Of the n-grams of a text of a learnt language most are near their rank in its profile (scores of 0.38 and more in the
#: test tables, words of two languages, keys and numbers included); a text of another script has a score of 0.
LEAST_SCORE = 0.2

#: SQL can express neither the tokenizer nor the fingerprints.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9.  Rejected, and gone, are documents without a letter (null and empty ones too) and those that are like no
    language learnt: of a score under ``LEAST_SCORE``.  A null lang becomes the predicted one; a given one stays as it is.
    Where no document has a lang there is nothing to be like, and all with a letter stay."""
    profiles = language.train_profiles(docs.where(~language.held_out(F.col("doc_id"))).select("lang", "text"))
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    known = language.identify(docs, profiles).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8.  Repeated chunks are cut out; a document of which nothing is left goes, and n_chars follows the text.
    Null and empty texts, single lines and repeated rows stay as they are (rows that agree in id and text are one document)."""
    cut = lines.dedup_lines(docs)
    left = cut.where((F.col("removed_chunks") == 0) | (F.col("removed_chunks") < F.col("n_chunks")))
    chars = F.when(F.col("removed_chunks") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3.  Of each group of near copies the document of least doc_id stays; rows without an id come last, rows that
    agree in id and text are one, and all null, empty and blank texts are one group."""
    # a row's key: its id, a null standing apart, and its text
    key = {"__k": F.coalesce(F.hex("doc_id"), F.lit("-")), "__t": F.xxhash64("text")}
    keyed = docs.withColumns(key)
    printed = stage(simhash.with_fingerprint(keyed.select("doc_id", "__k", "__t", "text")).drop("text"), "printed")
    grouped = simhash.near_duplicates(printed)
    # a group of rows without an id has its fingerprint for a name
    group = F.coalesce(F.hex("component_id"), F.concat(F.lit("-"), F.hex("__fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k", "__t")).alias("first")
    staying = grouped.groupBy(group.alias("g")).agg(first).select("first.__k", "first.__t")
    return keyed.join(staying, ["__k", "__t"], "left_semi").dropDuplicates(["__k", "__t"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6.  Each document is there as often as the mix takes it: rows of no words (null and empty texts) not at all;
    rows without a source are a source of their own."""
    mixed = mixing.mix(mixing.size_documents(docs))
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2.  The training sequences, piece by piece; a null or empty text is the closing id alone."""
    pieces = packing.token_pieces(docs, public_tokenizers.path(WORD_MODEL))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(stage(digests, "pieces"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next; what a stage
    wrote for itself, and what it read, is dropped when its result is written."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, function in STAGES[:-1]:
        with only_result_staged(spark, docs) as keep:
            docs = keep(stage(function(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
