import pytest
from pyspark.sql import functions as F

from clinflow.operators import learning
from clinflow.plans import models, retrain
from clinflow.sinks import tables

FEATURES = ["a", "b", "c"]


def test_samples_and_guard(rows):
    logs = rows("log_id INT, labeled BOOLEAN, used_for_training BOOLEAN, label STRING",
                (1, True, None, "x"), (2, True, True, "x"), (3, True, False, "new"), (4, False, None, "x"), (5, True, None, None))
    fresh = learning.new_samples(logs)
    assert sorted(r.log_id for r in fresh.collect()) == [1, 3, 5]
    assert sorted(r.log_id for r in learning.new_samples(logs.drop("used_for_training")).collect()) == [1, 2, 3, 5]
    classes = rows("label STRING", ("x",), ("y",))
    assert [r.log_id for r in learning.known_samples(fresh, classes, "label").collect()] == [1]
    assert sorted(r.log_id for r in learning.skipped_samples(fresh, classes, "label").collect()) == [3, 5]
    assert learning.training_guard(fresh, classes).first().status == "skipped"
    assert learning.training_guard(fresh, classes, force=True).first().status == "ready"
    assert learning.training_guard(fresh, classes.limit(1), force=True).first().status == "error"


def test_split_is_exact_per_class(spark):
    rows = spark.range(1003).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("label"))
    split = learning.stratified_split(rows, "id", "label")
    assert split.count() == 1003
    for row in split.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert row.t == int(row.n * 0.2)
    again = learning.stratified_split(rows.repartition(5), "id", "label")
    assert split.exceptAll(again).count() == 0


def test_split_cuts_inside_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(learning, "BUCKET_DIGITS", 1)
    rows = spark.range(500).select("id", F.lit("x").alias("label"))
    assert learning.stratified_split(rows, "id", "label").filter("is_test").count() == 100


def test_report_and_gate(rows):
    guess = rows("label STRING, prediction STRING", ("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"))
    assert learning.accuracy(guess).first().accuracy == 60.0
    report = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in learning.classification_report(guess).collect()}
    assert report == {"a": (0.5, 0.5, 0.5, 2), "b": (0.6667, 1.0, 0.8, 2), "c": (0.0, 0.0, 0.0, 1)}
    better = guess.withColumn("prediction", F.col("label"))
    assert learning.ab_gate(guess, better).first().deploy is True
    assert learning.ab_gate(better, guess).first().deploy is False
    assert learning.ab_gate(better, guess, force=True).first().deploy is True
    assert learning.ab_gate(None, guess).first().deploy is True


def test_vignettes(rows):
    pairs = rows("e STRING, p STRING", ("Allergy", "allergy"), ("Heart Attack (x)", "heart failure"), ("Hemorrhoids (Piles)", "Dimorphic hemmorhoids(piles)"),
                 ("Acne", "Psoriasis"), ("Acne", None))
    got = pairs.select(learning.is_hit(F.col("e"), F.col("p")).alias("h")).collect()
    assert [r.h for r in got] == [True, True, True, False, False]
    ranked = rows("expected STRING, disease STRING, score DOUBLE, rank INT", ("Acne", "Psoriasis", 0.5, 1), ("Acne", "Acne", 0.4, 2))
    results = learning.vignette_results(rows("expected STRING", ("Acne",), ("None known",)), ranked)
    assert {r.expected: (r.predicted, r.passed, r.top3) for r in results.collect()} == {
        "Acne": ("Psoriasis", False, "Psoriasis(50%), Acne(40%)"), "None known": ("NONE", True, "")}
    assert tuple(learning.vignette_summary(results).first()) == (1, 1)


@pytest.fixture
def logs(spark):
    kind = F.col("id") % 2
    return spark.range(120).select(
        F.col("id").alias("log_id"), F.array(F.when(kind == 0, "A ").otherwise("b"), F.lit("zz")).alias("symptoms"),
        F.when(F.col("id") % 10 == 9, "unseen").when(kind == 0, "X").otherwise("Y").alias("confirmed_disease"),
        F.lit(True).alias("labeled"), F.lit(None).cast("boolean").alias("used_for_training"), F.lit(None).cast("timestamp").alias("trained_at"))


def test_retrain(spark, rows, logs, tmp_path):
    classes, base, when = rows("label STRING", ("X",), ("Y",)), str(tmp_path / "models"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    tree = models.forest(trees=3, depth=3)
    few, same = retrain.retrain(logs.limit(10), None, FEATURES, classes, base, "0", when, tree)
    assert few.first().status == "skipped" and same.filter("used_for_training").count() == 0
    status, marked = retrain.retrain(logs, None, FEATURES, classes, base, "1", when, tree)
    row = status.first()
    assert (row.status, row.new_samples, row.total_train) == ("deployed", 120, 108 - 21)
    assert marked.filter("used_for_training").count() == 120
    assert tables.current_version(spark, base) == "1"
    again, kept = retrain.retrain(logs, None, FEATURES, classes, base, "2", when, tree)
    assert again.first().status == "not_deployed" and again.first().old_accuracy == 100.0
    assert kept.filter("used_for_training").count() == 0
    forced, _ = retrain.retrain(logs, None, FEATURES, classes, base, "3", F.lit("2024-01-02 00:00:00").cast("timestamp"), tree, force=True)
    assert forced.first().status == "deployed" and tables.current_version(spark, base) == "3"
    paths = {r.version: r.backup_path for r in tables.deployments(spark, base).read().collect()}
    assert paths == {"1": None, "3": f"{base}/v=1"}
    one = logs.filter("confirmed_disease = 'X'")
    assert retrain.retrain(one, None, FEATURES, classes, base, "4", when, tree, force=True)[0].first().status == "error"


def test_models_give_ranked_probabilities(spark, rows):
    table = rows("id INT, label STRING, vector ARRAY<INT>", *[(i, "XYZ"[i % 3], [int(i % 3 == k) for k in range(3)]) for i in range(60)])
    data = models.vector_from_array(table, "vector")
    for estimator in (models.forest(trees=5, depth=3), models.boosted(rounds=2, depth=2)):
        model = models.fit(data, estimator)
        assert models.classes(model) == ["X", "Y", "Z"]
        assert learning.accuracy(models.predictions(model, data)).first().accuracy == 100.0
        shares = models.probabilities(model, data, "id").first().probability
        assert abs(sum(shares) - 1) < 1e-6


def test_knowledge_per_disease(spark, rows):
    from clinflow.plans.knowledge import disease_knowledge

    texts = rows("item_id INT, content STRING, disease STRING, source STRING", (1, "malaria and its symptoms", "Malaria", "s"),
                 (2, "dengue and its treatment", "Dengue", "s"), (3, "nothing here at all", None, "s"), (4, "other words again", "X", "s"))
    model = models.text_embedder(128).fit(texts)
    chunks = models.embed(model, texts).select("item_id", "vector", "content", "disease", "source")
    got = disease_knowledge(rows("disease STRING", ("malaria",), ("dengue",), ("malaria",)), model, chunks, 2)
    best = {r.disease: [k.disease for k in r.knowledge] for r in got.collect()}
    assert {name: (first[0], len(first)) for name, first in best.items()} == {"malaria": ("Malaria", 2), "dengue": ("Dengue", 2)}


def noisy(spark, n):
    values = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double") for i in range(9)]
    return models.vector_from_array(spark.range(n).select("id", F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(4))).alias("label"), F.array(*values).alias("v")), "v")


def test_deep_forests_need_no_jobs_for_each_level(spark):
    data, context = noisy(spark, 600), spark.sparkContext
    context.setJobGroup("deep", "deep")
    try:
        model = models.fit(data, models.forest(trees=30))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("deep")) < 25
    # Noise is learned by heart only if the trees go down to single rows.
    assert learning.accuracy(models.predictions(model, data)).first().accuracy > 95


def test_deep_forests_below_a_top_and_after_loading(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from clinflow.operators.forest import DeepForest

    data = noisy(spark, 500)
    deep = DeepForest(models.forest(trees=20).top, group_rows=100)
    model = models.fit(data, deep)
    assert model.stages[1].top.getMaxDepth() > 2
    assert model.stages[1].nodes.count() > 20 * 4
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    twice = data.union(data)
    first, again = (models.probabilities(m, twice, "id").orderBy("id").collect() for m in (model, loaded))
    assert len(first) == 1000 and first == again and all(abs(sum(r.probability) - 1) < 1e-6 for r in first)
    assert learning.accuracy(models.predictions(loaded, data)).first().accuracy > 90


def test_a_tree_by_hand():
    import numpy as np

    from clinflow.operators.forest import fall, grow

    bins = np.array([[0, 5], [1, 5], [2, 5], [3, 5], [0, 9]], np.uint8)
    label = np.array([0, 0, 1, 1, 2])
    feature, cut, child, shares = grow(bins, label, np.array([1.0, 2, 1, 1, 1]), 3, 30, np.random.default_rng(1))
    assert shares[fall(bins, feature, cut, child)].argmax(1).tolist() == label.tolist()
    alone = grow(bins, label, np.array([1.0, 2, 1, 1, 1]), 3, 0, np.random.default_rng(1))
    assert alone[0].tolist() == [-1] and np.allclose(alone[3], [[3 / 6, 2 / 6, 1 / 6]])


def uneven(spark, n):
    """Four of five vectors are the same: no cut parts them."""
    same = F.col("id") % 5 != 0
    values = [F.when(same, 500.0).otherwise(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double")) for i in range(9)]
    label = F.concat(F.lit("c"), F.when(same, F.when(F.col("id") % 3 == 0, 1).otherwise(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(4))))
    return models.vector_from_array(spark.range(n).select("id", label.alias("label"), F.array(*values).alias("v")), "v")


def test_equal_rows_do_not_deepen_the_top(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from clinflow.operators.forest import UNEVEN, DeepForest

    data = uneven(spark, 1000)
    model = models.fit(data, DeepForest(models.forest(trees=10).top, group_rows=60))
    deep = model.stages[1]
    assert 1000 * 4 // 5 > UNEVEN * 60 and deep.top.getMaxDepth() == 5
    # The equal rows are split off by counts over all rows, and end as a leaf of their own.
    assert len(deep.deeper) > 0
    assert deep.nodes.select("tree", "leaf").distinct().count() == deep.nodes.count()
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    first, again = (models.probabilities(m, data, "id").orderBy("id").collect() for m in (model, loaded))
    assert len(first) == 1000 and first == again and all(abs(sum(r.probability) - 1) < 1e-6 for r in first)
    common = first[1].probability
    assert all(r.probability == common for r in first if r.id % 5) and abs(common[1] - 1 / 3) < 0.1
    found = models.predictions(model, data.where("id % 5 = 0"))
    assert learning.accuracy(found).first().accuracy > 90


def test_groups_stay_below_their_bound(spark, monkeypatch):
    from clinflow.operators import forest

    monkeypatch.setattr(forest, "UNEVEN", 1)
    data, seen = noisy(spark, 2000), {}
    model = models.fit(data, forest.DeepForest(models.forest(trees=8).top, group_rows=400)).stages[1]
    assert model.top.getMaxDepth() == 3 and model.deeper
    rows = model.blocks(data.withColumn("_row", F.col("id")), F.lit(0)).collect()
    for block in rows:
        ids, bins, leaf = (forest.unpacked([part], kind) for part, kind in zip((block.rows, block.bins, block.leaf), "qBi"))
        for tree, own in enumerate(leaf.reshape(-1, len(ids))):
            for node, part in forest.runs(forest.leaves(model.deeper, tree, own, bins.reshape(len(ids), -1))):
                seen[tree, node] = seen.get((tree, node), 0) + len(part)
    # Every place that rows come to has nodes, and holds about the drawn rows of a group at most.
    assert set(seen) == {(r.tree, r.leaf) for r in model.nodes.select("tree", "leaf").collect()}
    assert sum(seen.values()) == 8 * 2000 and max(seen.values()) < 400 * 1.5
