"""Training data, splits, evaluation and the deploy gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.operators.joining import lookup_join, top_rows

MIN_SAMPLES = 50
AB_THRESHOLD = 2.0
SEED = 42
BUCKET_DIGITS = 4


def new_samples(logs: DataFrame) -> DataFrame:
    """Labelled logs that no training has used; a missing or null mark counts as unused."""
    used = F.coalesce(F.col("used_for_training"), F.lit(False)) if "used_for_training" in logs.columns else F.lit(False)
    return logs.filter(F.col("labeled") & ~used)


def known_samples(samples: DataFrame, classes: DataFrame, label: str = "confirmed_disease") -> DataFrame:
    """Samples whose label is one of the (distinct) classes."""
    return lookup_join(samples, _classes(classes, label), [label], "left_semi")


def skipped_samples(samples: DataFrame, classes: DataFrame, label: str = "confirmed_disease") -> DataFrame:
    """Samples left out, because their label is unknown or missing."""
    return lookup_join(samples, _classes(classes, label), [label], "left_anti")


def _classes(classes: DataFrame, label: str) -> DataFrame:
    return classes.select(F.col(classes.columns[0]).alias(label)).distinct()


def training_guard(samples: DataFrame, classes: DataFrame, force: bool = False, least: int = MIN_SAMPLES,
                   label: str = "label") -> DataFrame:
    """One row (new_samples, classes, status): skipped, error or ready."""
    count = samples.agg(F.count("*").alias("new_samples"))
    kinds = classes.select(label).distinct().agg(F.count("*").alias("classes"))
    too_few = (F.col("new_samples") < least) & F.lit(not force)
    status = F.when(too_few, "skipped").when(F.col("classes") < 2, "error").otherwise("ready")
    return count.withColumn("classes", kinds.scalar()).withColumn("status", status)


def _order_text(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds `is_test`, true for exactly floor(share * n) rows of each label, the same in every run.

    Rows are ordered per label by a hash of the key. Counts per leading hash digits show in which
    bucket the cut falls; only rows of that one bucket are numbered, so a label with a third of all
    rows is never sorted by one task.
    """
    hashed = rows.withColumn("_h", _order_text(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    by_label = Window.partitionBy(label)
    counts = hashed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(by_label.orderBy("_b"))
    wanted = F.floor(F.sum("_n").over(by_label) * F.lit(share) + F.lit(1e-9))
    cuts = (
        counts.select(label, "_b", "_n", upto.alias("_upto"), wanted.alias("_wanted"))
        .filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
        .select(label, F.col("_b").alias("_cut"), (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    placed = lookup_join(hashed, cuts, [label], "left", spread=[key])
    edge = (F.col("_b") == F.col("_cut")) & F.col("_cut").isNotNull()
    sure = placed.filter(F.col("_cut").isNull() | (F.col("_b") != F.col("_cut"))).withColumn(
        "is_test", F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False))
    )
    at = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    close = placed.filter(edge).withColumn("is_test", at <= F.col("_need"))
    return sure.unionByName(close).drop("_h", "_b", "_cut", "_need")


def with_fold(rows: DataFrame, key: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """A fold number per row from a hash of its key."""
    digits = F.conv(F.substring(_order_text(F.col(key), seed), 1, 8), 16, 10).cast("long")
    return rows.withColumn("fold", F.pmod(digits, F.lit(folds)).cast("int"))


def label_index(rows: DataFrame, label: str = "label") -> DataFrame:
    """M1: classes in alphabetical order, numbered from 0."""
    kinds = rows.groupBy(label).agg(F.count("*").alias("n"))
    return kinds.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("label_index"), "n")


def accuracy(predictions: DataFrame) -> DataFrame:
    """Share of right predictions in percent, to two places; (label, prediction) rows."""
    right = F.count_if(F.col("label") == F.col("prediction"))
    return predictions.agg(F.coalesce(F.round(right * F.lit(100.0) / F.count("*"), 2), F.lit(0.0)).alias("accuracy"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    right = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(F.col("label").alias("class"), right.alias("tp"), F.col("n").alias("support"), F.lit(0).alias("predicted")).unionByName(
        cells.select(F.col("prediction").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("predicted"))
    )
    sums = sides.groupBy("class").agg(*[F.sum(name).alias(name) for name in ("tp", "support", "predicted")])
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    precision, recall = share(F.col("tp"), F.col("predicted")), share(F.col("tp"), F.col("support"))
    both = precision + recall
    return sums.select(
        "class", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(F.when(both > 0, F.lit(2.0) * precision * recall / both).otherwise(F.lit(0.0)), 4).alias("f1"), "support",
    )


def ab_gate(current: DataFrame | None, new: DataFrame, least: float = AB_THRESHOLD, force: bool = False) -> DataFrame:
    """M6: accuracies of both models on the same rows and whether to deploy; no current model deploys."""
    if current is None:
        gate = new.sparkSession.range(1).select(F.lit(0.0).alias("old_accuracy"), F.lit(0.0).alias("new_accuracy"))
        return gate.withColumn("deploy", F.lit(True))
    old_rate, new_rate = accuracy(current).scalar(), accuracy(new).scalar()
    gate = new.sparkSession.range(1).select(old_rate.alias("old_accuracy"), new_rate.alias("new_accuracy"))
    return gate.withColumn("deploy", F.lit(force) | (F.col("new_accuracy") - F.col("old_accuracy") >= least))


def blend_unrounded(overlap: DataFrame, model: DataFrame, key: str, top: int = 3) -> DataFrame:
    """The blend of the vignette check: all scores, no rounding before, no cut at ten."""
    sides = overlap.select(key, "disease", (F.col("score") * 0.7).alias("part")).unionByName(
        model.select(key, "disease", (F.col("probability") * 0.3).alias("part"))
    )
    merged = sides.groupBy(key, "disease").agg(F.sum("part").alias("score"))
    return top_rows(merged, [key], [F.desc("score"), F.asc("disease")], top, "rank")


def is_hit(expected: Column, predicted: Column) -> Column:
    """Names contain one another, or one holds the first word of the other, or both spell hemorrhoids."""
    a, b = F.lower(F.trim(expected)), F.lower(F.trim(predicted))
    word = lambda text: F.get(F.split(text, r"\s+"), F.lit(0))
    spelled = lambda x, y: F.contains(x, F.lit("hemorrhoids")) & F.contains(y, F.lit("hemmorhoids"))
    hit = (
        F.contains(b, a) | F.contains(a, b) | F.contains(b, word(a)) | F.contains(a, word(b)) | spelled(a, b) | spelled(b, a)
    )
    return F.coalesce(hit, F.lit(False))


def vignette_results(vignettes: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per vignette the best condition, whether it hits, and the top three as text."""
    lists = ranked.groupBy("expected").agg(F.array_sort(F.collect_list(F.struct("rank", "disease", "score"))).alias("r"))
    shown = F.transform("r", lambda p: F.format_string("%s(%.0f%%)", p["disease"], p["score"] * 100))
    joined = vignettes.select("expected").join(lists, "expected", "left")
    best = F.coalesce(F.get("r", F.lit(0))["disease"], F.lit("NONE"))
    return joined.select(
        "expected", best.alias("predicted"), is_hit(F.col("expected"), best).alias("passed"),
        F.coalesce(F.array_join(shown, ", "), F.lit("")).alias("top3"),
    )


def vignette_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
