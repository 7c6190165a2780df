"""Operator 7, URL filters: logistic regression on hashed character n-grams of host and path.

Method: rules decide the urls they fit; the classifier, trained on a small labelled table of urls,
decides the rest.  Features are the character n-grams of host and path, each with a mark for its part,
hashed into a fixed number of columns.

Defined cases: a null url or one without ``://`` has an empty host and path; repeated rows are judged
alike; if the labels are of one class or none, that class (allow where there is none) is the verdict of
every url no rule fits; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, start of the path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labelled urls that the classifier is trained on, at most.
MAX_LABELLED = 4000
FEATURES = 1 << 14
GRAMS = (3, 4)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none fits.  A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest goes outermost
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_grams(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path) with the array ``__grams`` of marked character n-grams."""

    def grams(text: Column, mark: str, n: int) -> Column:
        size = F.length(text)
        at = F.when(size >= n, F.sequence(F.lit(1), size - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(f"{mark}{n}"), F.substring(text, i, F.lit(n))))

    parts = [grams(F.concat(F.lit("^"), F.col(c), F.lit("$")), c[0], n) for c in ("host", "path") for n in GRAMS]
    return urls.withColumn("__grams", F.concat(*parts))


def train(labelled: DataFrame, features: int = FEATURES):
    """A model from ``labelled`` (host, path, label 1.0 = block); or the only label there is, or 0.0."""
    classes = [r["label"] for r in labelled.select("label").distinct().limit(2).collect()]
    if len(classes) < 2:
        return classes[0] if classes else 0.0
    hashed = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=features, binary=True).transform(with_grams(labelled))
    return LogisticRegression(featuresCol="__features", labelCol="label", rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__prediction", regParam=1e-3, maxIter=60, aggregationDepth=2).fit(hashed.select("label", "__features"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, max_labelled: int = MAX_LABELLED, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, block_probability and verdict.

    ``labelled`` has urls and labels (host, path, label).  By default it is drawn from the urls that a rule
    decides, the ``max_labelled`` of lowest hash, so that what the rules know carries over to like urls.
    """
    own = ("host", "path", "rule", "block_probability", "verdict")
    host, path = split_url(F.col(f"`{url}`"))
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in own])
    split = kept.withColumns({"host": host, "path": path})
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    if labelled is None:
        decided = split.select("host", "path").withColumn("label", F.when(by_rule == "block", 1.0).when(by_rule == "allow", 0.0)).where("label is not null")
        labelled = decided.dropDuplicates().orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled)
    model = train(labelled)
    marked = split.withColumns({"rule": rule, "__by_rule": by_rule})
    if isinstance(model, float):
        scored = marked.withColumn("block_probability", F.lit(model))
    else:
        hashed = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=FEATURES, binary=True).transform(with_grams(marked))
        scored = model.transform(hashed).withColumn("block_probability", vector_to_array("__probability")[1])
    verdict = F.coalesce(F.col("__by_rule"), F.when(F.col("block_probability") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.withColumn("verdict", verdict).select(*[F.col(f"`{c}`") for c in kept.columns], *own)
