"""Training data, splits, evaluation, models and the retrain loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from clinflow.lookups import seeds
from clinflow.operators import learning
from clinflow.operators.ranking import probabilities_from_vector, top_probabilities
from clinflow.plans import models, retrain
from clinflow.session import run_dir, written
from clinflow.sinks import tables
from clinflow.sources import matrix

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


UNUSED = "labeled AND NOT coalesce(used_for_training, false)"


@query("s2_unused_samples", f"WITH {b.LOGS_SQL} SELECT log_id, user_id, top_disease FROM logs WHERE {UNUSED}")
def s2(spark, sf):
    return learning.new_samples(b.logs(spark, sf)).select("log_id", "user_id", "top_disease")


CONFIRMED = "CASE WHEN log_id % 17 = 0 THEN 'unheard of' WHEN log_id % 19 <> 0 THEN top_disease END"


def samples(spark, sf):
    rows = b.logs(spark, sf).withColumn("confirmed_disease", F.expr(CONFIRMED))
    return learning.new_samples(rows)


def class_table(spark, sf):
    return b.table(spark, sf, "events").select(F.col("event_type").alias("label")).distinct()


SAMPLES_SQL = b.LOGS_SQL + f", samples AS (SELECT *, {CONFIRMED} AS confirmed_disease FROM logs WHERE {UNUSED})"
KNOWN = "confirmed_disease IN (SELECT event_type FROM events)"


@query("j10_known_labels", f"WITH {SAMPLES_SQL} SELECT log_id, confirmed_disease FROM samples WHERE {KNOWN}")
def j10(spark, sf):
    return learning.known_samples(samples(spark, sf), class_table(spark, sf)).select("log_id", "confirmed_disease")


@query("j10_skipped_labels", f"WITH {SAMPLES_SQL} SELECT confirmed_disease, count(*) AS n FROM samples WHERE NOT coalesce({KNOWN}, false) GROUP BY 1")
def j10_skipped(spark, sf):
    skipped = learning.skipped_samples(samples(spark, sf), class_table(spark, sf))
    return skipped.groupBy("confirmed_disease").agg(F.count("*").alias("n"))


@query("a13_training_guard", f"""WITH {SAMPLES_SQL}, c AS (SELECT (SELECT count(*) FROM samples) AS new_samples, (SELECT count(DISTINCT event_type) FROM events) AS classes)
SELECT new_samples, classes, CASE WHEN new_samples < 50 THEN 'skipped' WHEN classes < 2 THEN 'error' ELSE 'ready' END AS status FROM c""")
def a13(spark, sf):
    return learning.training_guard(samples(spark, sf), class_table(spark, sf))


MERGED_SQL = SAMPLES_SQL + f""", {b.FEATURES_SQL}, norm AS (SELECT log_id, confirmed_disease AS label,
  list_transform(symptoms, lambda s: replace(lower(trim(s)), ' ', '_')) AS t FROM samples WHERE {KNOWN}),
merged AS (SELECT 'log:' || log_id AS row_key, label, array_to_string(list_transform({b.text(seeds.FEATURES)}, lambda f: list_contains(t, f)::INT), '') AS vector FROM norm
  UNION ALL SELECT 'row:' || vec_id, (['click', 'error', 'purchase', 'signup', 'view'])[label % 5 + 1],
    array_to_string(list_transform(range(1, {len(seeds.FEATURES)} + 1), lambda i: (list_max(list_transform(range(i, len(embedding) + 1, {len(seeds.FEATURES)}), lambda j: embedding[j])) > 0)::INT), '') FROM embeddings)"""


def original(spark, sf):
    """A 0/1 matrix over the seed features: column i is 1 if any of the vector's values i, i + n, i + 2n … is above 0."""
    rows = b.table(spark, sf, "embeddings")
    names = F.lit(["click", "error", "purchase", "signup", "view"])
    n = len(seeds.FEATURES)
    any_of = lambda i: F.exists(F.filter("embedding", lambda x, at: at % n == i), lambda x: x > 0)
    columns = [any_of(i).cast("int").alias(name) for i, name in enumerate(seeds.FEATURES)]
    wide = rows.select("vec_id", F.get(names, F.col("label") % 5).alias("label"), *columns)
    return retrain.original_matrix(wide, seeds.FEATURES, "vec_id")


def merged(spark, sf):
    usable = learning.known_samples(samples(spark, sf), class_table(spark, sf))
    return matrix.merge_samples(original(spark, sf), retrain.sample_matrix(usable, seeds.FEATURES))


@query("u2_sample_merge", f"WITH {MERGED_SQL} SELECT * FROM merged")
def u2(spark, sf):
    return merged(spark, sf).withColumn("vector", F.array_join("vector", ""))


@query("e9_stratified_split", """WITH h AS (SELECT event_id, event_type, md5(event_id || ':42') AS h FROM events)
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id)
  <= floor(count(*) OVER (PARTITION BY event_type) * 0.2::DOUBLE + 1e-9::DOUBLE) AS is_test FROM h""")
def e9(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", "event_type")
    return learning.stratified_split(rows, "event_id", "event_type")


@query("e10_folds", """SELECT event_type, fold, count(*) AS n FROM (
  SELECT event_type, (('0x' || left(md5(event_id || ':42'), 8))::BIGINT % 5)::INT AS fold FROM events) GROUP BY ALL""")
def e10(spark, sf):
    rows = learning.with_fold(b.table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    return rows.groupBy("event_type", "fold").agg(F.count("*").alias("n"))


@query("m1_label_index", "SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS label_index, count(*) AS n FROM events GROUP BY event_type")
def m1(spark, sf):
    return learning.label_index(b.table(spark, sf, "events"), "event_type")


@query("a11_accuracy", f"SELECT {b.rounded('count(*) FILTER (quality = toxic) * 100.0::DOUBLE / count(*)', 2)} AS accuracy FROM labels")
def a11(spark, sf):
    rows = b.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return learning.accuracy(rows)


GUESS = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 WHEN vec_id % 11 = 0 THEN 11 ELSE label END"


@query("a12_class_report", f"""WITH p AS (SELECT label, {GUESS} AS prediction FROM embeddings),
c AS (SELECT class, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted FROM (
  SELECT label AS class FROM p UNION SELECT prediction FROM p)
  LEFT JOIN (SELECT label AS class, count(*) AS support, count(*) FILTER (label = prediction) AS tp FROM p GROUP BY 1) USING (class)
  LEFT JOIN (SELECT prediction AS class, count(*) AS predicted FROM p GROUP BY 1) USING (class)),
r AS (SELECT class, support, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS r FROM c)
SELECT class, {b.rounded('p', 4)} AS precision, {b.rounded('r', 4)} AS recall, CASE WHEN p + r > 0 THEN {b.rounded('2.0::DOUBLE * p * r / (p + r)', 4)} ELSE 0.0 END AS f1, support FROM r""")
def a12(spark, sf):
    return learning.classification_report(b.table(spark, sf, "embeddings").selectExpr("label", f"{GUESS} AS prediction"))


@query("m6_ab_gate", f"""WITH r AS (SELECT {b.rounded('count(*) FILTER (vec_id % 3 <> 0) * 100.0::DOUBLE / count(*)', 2)} AS old_accuracy,
  {b.rounded(f'count(*) FILTER (label = {GUESS}) * 100.0::DOUBLE / count(*)', 2)} AS new_accuracy FROM embeddings)
SELECT *, new_accuracy - old_accuracy >= 2.0::DOUBLE AS deploy FROM r""")
def m6(spark, sf):
    rows = b.table(spark, sf, "embeddings")
    old = rows.selectExpr("label", "CASE WHEN vec_id % 3 = 0 THEN label + 1 ELSE label END AS prediction")
    return learning.ab_gate(old, rows.selectExpr("label", f"{GUESS} AS prediction"))


def class_vectors(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return models.vector_from_array(rows, "embedding")


# Models are not SQL: the rows say what must hold for every model of a kind, and the tests look at accuracy.
KNOWN_CLASSES = "SELECT label::VARCHAR AS label, count(*) AS n, count(*) AS known, true AS better_than_chance FROM embeddings GROUP BY 1"


def judged(model, rows):
    """Per class: rows, rows with a prediction among the classes; and whether the whole beats the largest class."""
    found = models.predictions(model, rows)
    most = found.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"))
    right = found.agg(F.count_if(F.col("label") == F.col("prediction")))
    known = F.count_if(F.col("prediction").isin(models.classes(model)))
    return found.groupBy("label").agg(F.count("*").alias("n"), known.alias("known")).withColumn(
        "better_than_chance", right.scalar() > most.scalar())


@query("m2_forest", KNOWN_CLASSES)
def m2(spark, sf):
    rows = class_vectors(spark, sf)
    return judged(models.fit(rows, models.forest()), rows)


@query("m3_boosted", KNOWN_CLASSES)
def m3(spark, sf):
    rows = class_vectors(spark, sf)
    return judged(models.fit(rows, models.boosted(rounds=2, depth=3)), rows)


@query("m4_model_choice", "SELECT * FROM (VALUES ('forest', true, true), ('boosted', true, true)) AS v(model, in_range, chosen_is_best)")
def m4(spark, sf):
    rows = class_vectors(spark, sf)
    indexed = written(models.indexer().fit(rows).transform(rows).select("vec_id", "label_index", "features"), "folds")
    candidates = {"forest": models.forest(trees=5, depth=4), "boosted": models.boosted(rounds=1, depth=2)}
    best, rates = models.choose(indexed, candidates, "vec_id", folds=2)
    top = max(mean for mean, _ in rates.values())
    return spark.createDataFrame(
        [(name, 0 <= mean <= 1 and 0 <= spread <= 0.5, (name == best) == (mean == top)) for name, (mean, spread) in rates.items()],
        "model STRING, in_range BOOLEAN, chosen_is_best BOOLEAN",
    )


@query("m5_batch_scoring", """SELECT vec_id, 3::BIGINT AS n, true AS ranked, true AS in_range, true AS known FROM embeddings""")
def m5(spark, sf):
    rows = class_vectors(spark, sf)
    model = models.fit(rows, models.forest())
    scores = models.probabilities(model, rows, "vec_id")
    top = top_probabilities(probabilities_from_vector(scores, models.classes(model), "vec_id"), "vec_id", 3)
    lists = top.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "confidence", "disease"))).alias("r"))
    falling = F.forall(F.transform("r", lambda x, i: (i == 0) | (F.get("r", i - 1)["confidence"] >= x["confidence"])), lambda x: x)
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["confidence"])
    return lists.select(
        "vec_id", F.size("r").cast("long").alias("n"), falling.alias("ranked"), ((total > 0) & (total <= 1.0001)).alias("in_range"),
        F.forall("r", lambda x: x["disease"].isin(models.classes(model))).alias("known"))


OLD_GUESS = "CASE WHEN vec_id % 3 = 0 THEN label + 1 ELSE label END"


@query("k8_k9_model_versions", f"""WITH r AS (SELECT {b.rounded('count(*) FILTER (vec_id % 3 <> 0) * 100.0::DOUBLE / count(*)', 2)} AS first_rate,
  {b.rounded(f'count(*) FILTER (label = {GUESS}) * 100.0::DOUBLE / count(*)', 2)} AS second_rate,
  max(len(embedding))::INT AS n_features, count(DISTINCT label)::INT AS n_classes, string_agg(DISTINCT label::VARCHAR, '|' ORDER BY label::VARCHAR) AS diseases FROM embeddings)
SELECT '1' AS version, 0.0::DOUBLE AS old_accuracy, first_rate AS new_accuracy, first_rate AS improvement, 'forest' AS type, n_features, n_classes, diseases FROM r UNION ALL
SELECT '2', first_rate, second_rate, {b.rounded('second_rate - first_rate', 2)}, 'forest', n_features, n_classes, diseases FROM r""")
def k8(spark, sf):
    """Two deployments with the rates of two sets of predictions over the whole table, and what was saved of the model."""
    rows = class_vectors(spark, sf)
    model = models.fit(rows, models.forest(trees=5, depth=4))
    base = run_dir(spark, "models")
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"d{i}" for i in range(size)]
    stamp = lambda day: F.lit(f"2024-02-0{day} 00:00:00")
    table = b.table(spark, sf, "embeddings")
    guesses = [table.selectExpr("label", f"{guess} AS prediction") for guess in (OLD_GUESS, GUESS)]
    first = learning.accuracy(guesses[0]).first().accuracy
    gate = learning.ab_gate(*guesses).first()
    tables.deploy_model(model, base, "1", names, "forest", 0.0, first, stamp(1))
    deployed = tables.deploy_model(model, base, "2", names, "forest", gate.old_accuracy, gate.new_accuracy, stamp(2))
    meta = spark.read.parquet(f"{base}/metadata").select("version", "type", "n_features", "n_classes", b.bar("diseases").alias("diseases"))
    return deployed.join(meta, "version").select(
        "version", "old_accuracy", "new_accuracy", "improvement", "type", "n_features", "n_classes", "diseases")


@query("m7_retrain", f"""WITH {MERGED_SQL}, kinds AS (SELECT label, count(*) AS n FROM merged GROUP BY 1)
SELECT 'deployed' AS status, (SELECT count(*) FROM samples) AS new_samples,
  (SELECT sum(n - floor(n * 0.2::DOUBLE + 1e-9::DOUBLE))::BIGINT FROM kinds) AS total_train, (SELECT count(*) FROM samples) AS marked""")
def m7(spark, sf):
    logs = b.logs(spark, sf).withColumn("confirmed_disease", F.expr(CONFIRMED)).withColumn("trained_at", F.lit(None).cast("timestamp"))
    status, marked = retrain.retrain(
        logs, original(spark, sf), seeds.FEATURES, class_table(spark, sf), run_dir(spark, "models"), "1",
        F.lit("2024-02-01 00:00:00").cast("timestamp"), models.forest(trees=5, depth=5),
    )
    used = marked.agg(F.count_if(F.col("trained_at").isNotNull()).alias("marked"))
    return status.select("status", "new_samples", "total_train").withColumn("marked", used.scalar())
