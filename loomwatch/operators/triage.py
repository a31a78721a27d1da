"""A learned second opinion: features from rule-owned facts, class weights, stratified folds, prediction, agreement. The rules keep
every severity; the opinion is advisory."""

from __future__ import annotations

import functools
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators.score import ratio
from loomwatch.sources.envelopes import lookup

FAMILIES = {
    "family_auth": r"(?i)auth|brute|login|credential", "family_scan": r"(?i)scan|exposure|nmap|url_", "family_threat": r"(?i)threat|malware|ioc|c2|outbound",
    "family_error": r"(?i)error|disk|critical_service|resource|generic|zookeeper", "family_windows": r"(?i)^windows_",
}
NAMES = [*FAMILIES, "family_other", "rules", "occurrences", "lines", "techniques", "ips", "users", "hosts", "ports", "entities", "steps", "span_s", "per_minute", "timed", "criticality"]


def _size(c: str) -> Column:
    return F.coalesce(F.array_size(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))), F.lit(0)).cast("double")


def features(findings: DataFrame) -> DataFrame:
    """Adds one double per name. In: types, techniques, ips, users, hosts, ports (array<string>), lines (array<long>), step_us (array<long>),
    occurrences, criticality. Nothing else of a finding is read."""
    blob = F.array_join("types", " ")
    d = findings.withColumns({n: blob.rlike(rx).cast("double") for n, rx in FAMILIES.items()})
    d = d.withColumn("family_other", (sum((F.col(n) for n in FAMILIES), F.lit(0.0)) == 0).cast("double"))
    us = F.coalesce("step_us", F.array().cast("array<bigint>"))
    timed = F.size(us) >= 2
    span = F.when(timed, (F.array_max(us) - F.array_min(us)) / 1e6).otherwise(0.0)
    n = F.greatest(F.coalesce(F.col("occurrences").cast("double"), F.lit(1.0)), F.lit(1.0))
    sized = {"rules": "types", "techniques": "techniques", "ips": "ips", "users": "users", "hosts": "hosts", "ports": "ports"}
    return d.withColumns(
        {k: _size(c) for k, c in ((f"f_{k}", c) for k, c in sized.items())}
        | {
            "f_occurrences": n, "f_lines": F.coalesce(F.size("lines"), F.lit(0)).cast("double"), "f_steps": F.size(us).cast("double"), "f_span_s": span,
            "f_per_minute": F.when(span > 0, n / (span / 60.0)).otherwise(0.0), "f_timed": timed.cast("double"),
            "f_criticality": lookup({"crown-jewel": 2.0, "standard": 1.0, "low": 0.0}, F.coalesce("criticality", F.lit("standard")), F.lit(1.0)),
        }
    ).withColumn("f_entities", F.col("f_ips") + F.col("f_users") + F.col("f_hosts") + F.col("f_ports"))


def vector_names() -> list[str]:
    return [n if n.startswith("family") else f"f_{n}" for n in NAMES]


def class_weights(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = n / (classes * count of the class)."""
    per = labelled.groupBy(label).agg(F.count("*").alias("_n"))
    total = per.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    w = per.crossJoin(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return labelled.join(F.broadcast(w), label)


def folds(labelled: DataFrame, k: int = 5, label: str = "label", order: str = "id", buckets: int = 256) -> DataFrame:
    """Adds fold: rows of each class dealt in turn. They are counted in hash buckets with bucket offsets, so that no class meets in
    one task."""
    d = labelled.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    before = F.sum("_n").over(W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    base = d.groupBy(label, "_b").agg(F.count("*").alias("_n")).select(F.col(label).alias("_l"), F.col("_b").alias("_of"), F.coalesce(before, F.lit(0)).alias("_base"))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(label, "_b").orderBy(order)) - 1)
    j = d.join(base, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_of")))
    return j.withColumn("fold", ((F.col("_base") + F.col("_k")) % k).cast("int")).drop("_b", "_k", "_l", "_of", "_base")


def fit(train: DataFrame, label: str = "label", trees: int = 40, depth: int = 6, seed: int = 7):
    """A random forest over the feature vector with class weights; deterministic by seed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    stages = [
        VectorAssembler(inputCols=vector_names(), outputCol="_x"), index,
        RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, predictionCol="_p"),
        IndexToString(inputCol="_p", outputCol="opinion", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(class_weights(train, label))


def confusion_scores(predicted: DataFrame, label: str = "label", opinion: str = "opinion") -> DataFrame:
    """accuracy and macro F1, from counts per pair of classes."""
    c = predicted.groupBy(F.col(label).alias("a"), F.col(opinion).alias("b")).agg(F.count("*").alias("n"))
    sides = c.select("a", "b", "n", F.explode(F.array_distinct(F.array("a", "b"))).alias("c"))
    per = sides.groupBy("c").agg(
        F.sum(F.when((F.col("a") == F.col("c")) & (F.col("b") == F.col("c")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("b") == F.col("c")) & (F.col("a") != F.col("c")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("a") == F.col("c")) & (F.col("b") != F.col("c")), F.col("n")).otherwise(0)).alias("fn"),
    )
    f = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    macro = per.agg(F.round(F.avg(f), 4).alias("macro_f1"))
    acc = c.agg(ratio(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"), F.sum("n").alias("rows"))
    return acc.crossJoin(macro)


def fold_scores(predicted: DataFrame, label: str = "label", opinion: str = "opinion") -> DataFrame:
    """(fold, rows, accuracy, macro_f1) of all folds in one pass over counts per (fold, label, opinion)."""
    c = predicted.groupBy("fold", F.col(label).alias("a"), F.col(opinion).alias("b")).agg(F.count("*").alias("n"))
    sides = c.select("fold", "a", "b", "n", F.explode(F.array_distinct(F.array("a", "b"))).alias("c"))
    right = F.col("a") == F.col("b")
    per = sides.groupBy("fold", "c").agg(
        F.sum(F.when(right, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~right & (F.col("b") == F.col("c")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~right & (F.col("a") == F.col("c")), F.col("n")).otherwise(0)).alias("fn"),
    )
    f = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    acc = c.groupBy("fold").agg(F.sum("n").alias("rows"), ratio(F.sum(F.when(right, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return acc.join(per.groupBy("fold").agg(F.round(F.avg(f), 4).alias("macro_f1")), "fold")


def spread(scores: DataFrame, names: tuple[str, ...] = ("accuracy", "macro_f1")) -> DataFrame:
    """(metric, min, max, mean) over folds."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names)))
    d = scores.select(each.alias("_e")).select("_e.*")
    return d.groupBy("metric").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 4).alias("mean"))


def cross_validate(folded: DataFrame, k: int = 5, label: str = "label", at_once: int = 3, **settings) -> DataFrame:
    """Every row of ``folded`` (features, label, fold) with the opinion of the model that did not see its fold. Fits run ``at_once`` side by side, as Spark's own
    cross-validator does; the fold's rows are scored within one plan."""

    def one(fold: int) -> DataFrame:
        train, held = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        return fit(train, label, **settings).transform(held.withColumn("weight", F.lit(1.0))).select(*folded.columns, "opinion")

    with ThreadPool(min(at_once, k)) as pool:
        parts = pool.map(inheritable_thread_target(one), range(k))
    return functools.reduce(DataFrame.unionByName, parts)


def importance(model, held: DataFrame, key: str, label: str = "label", rows_a_range: int = 10_000) -> DataFrame:
    """(feature, accuracy, drop) by permutation, in one scoring pass: each row is scored as it is (feature null) and once for each feature with that feature's
    value of another row, the next one in the order of a hash salted by the feature. That order is cut in ranges, the last row of a range takes
    the value of its first, so that no task holds a whole column."""
    names = vector_names()
    ranges = 1 + held.count() // rows_a_range
    cells = held.select(F.col(key).alias("_k"), F.posexplode(F.array(*(F.col(n).cast("double") for n in names))).alias("_f", "_v"))
    cells = cells.withColumn("_h", F.xxhash64("_k", "_f")).withColumn("_r", F.pmod("_h", F.lit(ranges)))
    w = W.partitionBy("_f", "_r").orderBy("_h", "_k")
    first = F.first("_v").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    last = F.lead("_k").over(w).isNull()
    other = cells.select("_k", "_f", F.when(last, first).otherwise(F.lead("_v").over(w)).alias("_v"))
    each = held.join(other, F.col(key) == F.col("_k")).withColumns({n: F.when(F.col("_f") == k, F.col("_v")).otherwise(F.col(n)) for k, n in enumerate(names)})
    plain = held.withColumn("_f", F.lit(-1))
    scored = model.transform(each.select(*held.columns, "_f").unionByName(plain).withColumn("weight", F.lit(1.0)))
    per = scored.groupBy("_f").agg(F.avg((F.col("opinion") == F.col(label).cast("string")).cast("double")).alias("accuracy"))
    base = per.filter("_f = -1").select(F.col("accuracy").alias("_base"))
    feature = F.when(F.col("_f") >= 0, F.try_element_at(F.array(*map(F.lit, names)), F.col("_f") + 1)).alias("feature")
    return per.crossJoin(F.broadcast(base)).select(feature, "accuracy", (F.col("_base") - F.col("accuracy")).alias("drop"))  # one row a feature


def agreement(predicted: DataFrame, severity: str = "severity", opinion: str = "opinion") -> DataFrame:
    """How often the opinion agrees with the rules, by severity."""
    return predicted.groupBy(F.upper(severity).alias("severity")).agg(
        F.count("*").alias("n"), F.count_if(F.upper(opinion) == F.upper(severity)).alias("agree"), F.count_if(F.upper(opinion) != F.upper(severity)).alias("disagree")
    )


def sensitivity(model, findings: DataFrame, key: str = "id") -> DataFrame:
    """Findings whose opinion changes when the asset's criticality alone is forced to each level."""
    spark = findings.sparkSession
    levels = spark.createDataFrame([(c,) for c in P.CRITICALITY_WEIGHT], "_c string")
    d = findings.drop("criticality").crossJoin(F.broadcast(levels)).withColumnRenamed("_c", "criticality")
    out = model.transform(features(d).withColumn("weight", F.lit(1.0)))
    return out.groupBy(key).agg(F.count_distinct("opinion").alias("opinions")).withColumn("flips", F.col("opinions") > 1)
