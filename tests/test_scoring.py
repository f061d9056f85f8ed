import pytest
from pyspark.sql import functions as F

from clinflow.functions import scoring
from clinflow.functions.text import split_form_terms
from clinflow.lookups import language, tables
from clinflow.lookups.severity import SEVERITY_WEIGHTS
from clinflow.operators import cleanse, joining, mapping, medicines, ranking
from clinflow.operators.terms import TermStore
from clinflow.plans.scoring import Lookups, advisory_requests, responses, score_requests, with_severity

REQUEST = "request_id INT, symptoms ARRAY<STRING>, duration_days INT, age INT"
CASES = [
    (1, ["cough"], 1, 30, 6, "LOW"),
    (2, ["chest_pain", "difficulty_breathing", "vomiting_blood"], 5, 70, 100, "HIGH"),
    (3, ["chest_pain"] * 20, 30, 80, 100, "HIGH"),
    (4, ["chest_pain", "breathlessness", "high_fever"], 7, 65, 100, "HIGH"),
    (5, ["headache"], 1, 20, 11, "LOW"),
    (6, ["fever", "cough"], 3, 25, 27, "LOW"),
    (7, ["fever", "cough"], 3, 70, 35, "LOW"),
    (8, ["made up term"], 10, 30, 10, "LOW"),
    (9, ["made up term"], 11, 30, 10, "LOW"),
    (10, ["headache"], 0, 4, 13, "LOW"),
    (11, ["headache"], 0, 5, 10, "LOW"),
    (12, ["headache"], 0, 60, 10, "LOW"),
    (13, ["headache"], 0, 61, 13, "LOW"),
    (14, ["headache"], -20, 30, -10, "LOW"),
    (15, [], 1, 30, 0, "LOW"),
    (16, ["High Fever ", "high_fever"], 0, 30, 40, "MEDIUM"),
]


def test_severity_in_row_and_as_join(spark, rows):
    requests = rows(REQUEST, *[case[:4] for case in CASES])
    want = {case[0]: case[4:] for case in CASES}
    in_row = with_severity(requests, tables.risk_bands(spark))
    assert {r.request_id: (r.severity, r.risk_level) for r in in_row.collect()} == want
    joined = mapping.weighted_severity(requests, tables.severity_weights(spark))
    assert {r.request_id: r.severity for r in joined.collect()} == {k: v[0] for k, v in want.items()}


def test_band_edges(spark):
    got = spark.range(101).select("id", scoring.risk_level(F.col("id")).alias("level")).collect()
    assert {r.id: r.level for r in got if r.id in (39, 40, 69, 70)} == {39: "LOW", 40: "MEDIUM", 69: "MEDIUM", 70: "HIGH"}


def test_lookup_sizes():
    assert len(SEVERITY_WEIGHTS) == 105
    assert len(set(language.ROMAN_URDU_HINTS)) == len(language.ROMAN_URDU_HINTS)
    assert (len(language.PHRASES), len(language.STRONG_HINTS), len(language.REPLY_TERMS)) == (61, 18, 37)


def test_validation_takes_the_first_failing_rule(rows):
    checked = cleanse.validate_requests(rows(
        "request_id INT, symptoms STRING, duration_days STRING, age STRING",
        (1, "cough, fever ,", None, None), (2, "", "1", "30"), (3, " , ", "x", "30"), (4, ",".join(["a"] * 21), "1", "30"),
        (5, "b," + "a" * 201, "1", "30"), (6, "cough", "1.5", "30"),
    ))
    good, bad = cleanse.split_valid(checked)
    assert [(r.request_id, r.symptoms, r.duration_days, r.age) for r in good.collect()] == [(1, ["cough", "fever"], 1, 30)]
    assert {r.request_id: r.reason for r in bad.collect()} == {
        2: "no symptoms", 3: "not an integer", 4: "too many symptoms", 5: "symptom too long", 6: "not an integer"}


def test_form_terms(rows):
    out = rows("t STRING, l STRING", ("Sar  Dard;bukhar\nX", "ur"), ("Sar Dard, Y", "en")).select(
        split_form_terms("t", "l", language.FORM_TERMS).alias("x")).collect()
    assert [r.x for r in out] == [["headache", "fever", "x"], ["sar dard", "y"]]


def test_term_stages(spark, rows):
    terms = rows("raw STRING", *[(t,) for t in (
        "high fever", "body aches", "headaches", "high fever severe headache joint pain skin rash", "zzzzqq", "hair fall",
        "vomitting", "  ")])
    for native in (True, False):
        resolved = mapping.resolve_terms(terms, tables.features(spark), tables.synonyms(spark), native=native)
        got = {r.raw: (r.stage, r.features) for r in resolved.collect()}
        assert got["high fever"] == ("exact", ["high_fever"])
        assert got["body aches"] == ("synonym", ["joint_pain", "muscle_pain"])
        assert got["headaches"] == ("plural", ["headache"])
        assert got["vomitting"] == ("fuzzy", ["vomiting"])
        assert got["zzzzqq"] == ("unmatched", [])
        assert got["hair fall"] == ("synonym", [])  # listed, though none of its features is known
        assert "  " not in got
        blob = got["high fever severe headache joint pain skin rash"]
        assert blob == ("extracted", ["headache", "high_fever", "joint_pain", "skin_rash"])


def test_phrase_order_for_short_and_long_lists(spark, rows):
    phrases = mapping.known_phrases(tables.features(spark), tables.synonyms(spark))
    texts = rows("raw STRING", ("High fever  severe headache joint pain skin rash",), ("nothing",), ("",),
                 ("skin skin rash rash",), ("coughcough",))
    want = {
        "High fever  severe headache joint pain skin rash": ["severe headache", "high fever", "joint pain", "skin rash"],
        "nothing": [], "": [], "skin skin rash rash": ["skin rash", "skin rash"], "coughcough": ["cough", "cough"],
    }
    assert {r.raw: r.found for r in mapping.extract_phrases(texts, phrases).collect()} == want
    many = phrases.unionByName(spark.range(6_000).selectExpr("concat('unheard of phrase ', id) AS phrase"))
    assert {r.raw: r.found for r in mapping.extract_phrases(texts, many).collect()} == want


def test_fuzzy_matches_brute_force(spark, rows):
    import difflib

    vocabulary = [r.feature for r in tables.features(spark).collect()]
    words = ["dizzyness", "paine", "fevr", "coughh", "x", "back_pains", "chest", "swelling", "lossofbalance", "nausia_"]
    got = {r.norm: (r.feature, round(r.score, 6)) for r in mapping.fuzzy_ratio(rows("norm STRING", *[(w,) for w in words]), tables.features(spark)).collect()}
    for word in words:
        close = difflib.get_close_matches(word, vocabulary, n=1, cutoff=0.55)
        if close:
            ratio = difflib.SequenceMatcher(None, close[0], word).ratio()
            assert got[word] == (close[0], round(ratio, 6))
        else:
            assert word not in got


def test_lookup_join_past_the_broadcast_bound(spark):
    facts = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        wide = joining.lookup_join(facts, table, ["k"], how, spread=["id"], salts=5)
        near = joining.lookup_join(facts, table, ["k"], how)
        assert sorted(map(tuple, wide.select(*near.columns).collect()), key=repr) == sorted(map(tuple, near.collect()), key=repr)


def test_overlap_and_blend(spark, rows):
    matched = rows("request_id INT, matched ARRAY<STRING>", (1, ["a", "b"]), (2, ["z"]), (3, ["a"]))
    diseases = rows("disease STRING, features ARRAY<STRING>", ("D1", ["a", "b"]), ("D2", ["a", "c", "d"]), ("D3", ["q"]))
    overlap = ranking.overlap_scores(matched, diseases)
    salted = ranking.overlap_scores(matched, diseases, salts=4)
    assert sorted(map(tuple, overlap.collect())) == sorted(map(tuple, salted.collect()))
    twice = ranking.overlap_scores(matched, diseases.unionByName(rows("disease STRING, features ARRAY<STRING>", ("D1", ["a"]))))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, overlap.collect()))
    assert {(r.request_id, r.disease): (r.confidence, r.overlap, r.pos) for r in overlap.collect()} == {
        (1, "D1"): (1.0, 2, 1), (1, "D2"): (0.4, 1, 2), (3, "D1"): (0.6667, 1, 1), (3, "D2"): (0.5, 1, 2)}
    model = ranking.top_probabilities(rows("request_id INT, disease STRING, probability DOUBLE",
                                           (1, "D3", 0.5), (1, "D1", 0.25), (1, "D2", 0.0), (2, "D2", 1.0)))
    ranked = ranking.blend_scores(overlap, model)
    assert {(r.request_id, r.rank): (r.disease, r.confidence) for r in ranked.collect()} == {
        (1, 1): ("D1", 0.775), (1, 2): ("D2", 0.28), (1, 3): ("D3", 0.15), (2, 1): ("D2", 0.3),
        (3, 1): ("D1", 0.4667), (3, 2): ("D2", 0.35)}


def test_medicine_tiers(rows):
    drugs = "disease STRING, drug_name STRING, drug_type STRING, pos INT"
    first = medicines.tier_lists(rows(drugs, ("A", "x", "otc", 1)), "pos")
    second = medicines.tier_lists(rows(drugs, ("A", "no", "otc", 1), ("B", "z", "prescription", 2), ("B", "y", "prescription", 1)), "pos")
    asked = rows("id INT, disease STRING, medicine_type STRING", (1, "A", "otc"), (2, "B", "prescription"), (3, "C", "otc"), (4, None, "otc"), (5, "A", "prescription"))
    got = {r.id: (r.otc, r.prescription, r.recommended, r.source) for r in medicines.suggest_medicines(asked, [("one", first), ("two", second)]).collect()}
    assert got[1] == (["x"], [], ["x"], "one")
    assert got[2] == ([], ["y", "z"], ["y", "z"], "two")
    assert got[3][3] == "static" and got[4] == got[3] and got[5][2] == []


def test_whole_scoring(spark, rows):
    lookups = Lookups(tables.features(spark), tables.synonyms(spark), tables.disease_features(spark), tables.risk_bands(spark),
                      [("static", medicines.tier_lists(tables.medicines(spark), "pos"))])
    requests = rows("request_id INT, user_id STRING, symptoms ARRAY<STRING>, duration_days INT, age INT",
                    (1, "u", ["fever", "chills", "sweating", "headache"], 2, 30), (2, "u", ["zzzzqq"], 1, 30))
    scored = score_requests(requests, lookups)
    got = {r.request_id: r for r in scored.collect()}
    assert got[1].top_disease == "Malaria" and len(got[1].predictions) == 3 and got[1].source == "static"
    assert got[2].top_disease == "Unknown" and got[2].predictions == []
    assert responses(scored).count() == 2
    assert "1. Malaria" in {r.request_id: r.request_text for r in advisory_requests(scored).collect()}[1]


def test_numbers_lose_their_fraction_but_texts_must_be_whole(rows):
    from clinflow.operators.cleanse import validate_requests

    numbers = rows("symptoms ARRAY<STRING>, duration_days DOUBLE, age DOUBLE", (["a"], 2.7, 40.0), (["a"], None, None))
    assert [(r.duration_days, r.age, r.reason) for r in validate_requests(numbers).collect()] == [(2, 40, None), (1, 30, None)]
    texts = rows("symptoms ARRAY<STRING>, duration_days STRING, age STRING", (["a"], "2.7", "40"))
    assert validate_requests(texts).first().reason == "not an integer"


def test_the_model_is_silent_for_unmatched_requests(spark, rows):
    lookups = Lookups(tables.features(spark), tables.synonyms(spark), tables.disease_features(spark), tables.risk_bands(spark),
                      [("static", medicines.tier_lists(tables.medicines(spark), "pos"))])
    requests = rows("request_id INT, user_id STRING, symptoms ARRAY<STRING>, duration_days INT, age INT",
                    (1, "u", ["fever"], 2, 30), (2, "u", ["hair fall"], 1, 30))
    model = rows("request_id INT, disease STRING, probability DOUBLE", (1, "Dengue", 0.9), (2, "Dengue", 0.9))
    got = {r.request_id: r for r in score_requests(requests, lookups, model).collect()}
    assert "Dengue" in [p.disease for p in got[1].predictions]
    assert got[2].predictions == [] and got[2].top_disease == "Unknown"


def test_plans_read_no_request_while_they_are_built(spark, rows):
    """Vocabularies are counted and sent when a plan is made; the requests themselves would fail if they were read."""
    requests = rows("request_id INT, user_id STRING, symptoms ARRAY<STRING>, duration_days INT, age INT", (1, "u", ["fever"], 2, 30))
    unread = requests.withColumn("symptoms", F.when(F.raise_error(F.lit("read")).isNull(), F.col("symptoms")))
    lookups = Lookups(tables.features(spark), tables.synonyms(spark), tables.disease_features(spark), tables.risk_bands(spark),
                      [("static", medicines.tier_lists(tables.medicines(spark), "pos"))])
    scored = score_requests(unread, lookups, rows("request_id INT, disease STRING, probability DOUBLE", (1, "Dengue", 0.9)))
    with pytest.raises(Exception, match="read"):
        scored.collect()


def test_only_unseen_terms_are_resolved(spark, rows, tmp_path):
    store = TermStore(str(tmp_path), tables.features(spark), tables.synonyms(spark), native=True)
    first, second = ["high fever", "body aches", "zzzzqq", " "], ["body aches", "headaches", "zzzzqq", None]
    frame = lambda words: rows("raw STRING", *[(w,) for w in words])
    parts = lambda: {r.batch_id: r["count"] for r in spark.read.parquet(store.folder()).groupBy("batch_id").count().collect()}
    store.resolved(frame(first))
    assert parts() == {0: 3}
    store.resolved(frame(second))
    assert parts() == {0: 3, 1: 1}
    both = store.resolved(frame([*first, *second]))
    assert parts() == {0: 3, 1: 1}  # known terms resolve none
    want = mapping.resolve_terms(frame([*first, *second]), tables.features(spark), tables.synonyms(spark), native=True)
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    again = store.resolved(frame(second), batch_id=1)  # a repeated batch replaces its own part
    assert parts() == {0: 3, 1: 1} and again.count() == 4
    other = TermStore(str(tmp_path), tables.features(spark).filter("feature <> 'headache'"), tables.synonyms(spark), native=True)
    assert other.folder() != store.folder()
    assert "headache" not in {f for r in other.resolved(frame(["headaches"])).collect() for f in r.features}


def test_extraction_runs_on_distinct_terms(spark, rows):
    """No filter on the extracted phrases may stand below the step that makes the terms distinct."""
    terms = rows("raw STRING", ("high fever skin rash",), ("high fever skin rash",))
    resolved = mapping.resolve_terms(terms, tables.features(spark), tables.synonyms(spark), native=True)
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(sequence(1") == 1 and plan.count("Generate explode") <= 6
    bottom = plan[plan.rindex("Aggregate [raw"):]
    assert "aggregate(sequence(1" not in bottom


def test_letters_in_common_bound_the_work_and_lose_nothing(spark):
    """A vocabulary of 100,000 names: few of the pairs of a possible length are scored, and the best name is that of all names."""
    digits = "concat(conv(pmod(xxhash64(id), 1679616), 10, 36), conv(pmod(xxhash64(id, 1), 1679616), 10, 36))"
    names = spark.range(100_000).selectExpr(f"lower({digits}) AS feature").distinct()
    held = [r.feature for r in names.filter("pmod(xxhash64(feature, 3), 10000) = 0").orderBy("feature").limit(6).collect()]
    words = [w[:3] + ("x" if w[3] != "x" else "y") + w[4:] for w in held[:3]] + [w[::-1] for w in held[3:]] + ["zzzzzzzz", "é漢𝄞é"]
    terms = spark.createDataFrame([(w,) for w in words], "norm STRING")
    rows = terms.withColumn("_open", F.col("norm"))
    work = mapping._candidates(rows, ["norm"], names, 0.55, True).agg(F.sum("_listed").alias("listed"), F.sum(F.size("candidates")).alias("scored")).first()
    assert 0 < work.scored <= 0.05 * work.listed
    alike = F.lit(1.0) - F.levenshtein("norm", "feature") / F.greatest(F.length("norm"), F.length("feature"))
    every = terms.join(F.broadcast(names), F.length("feature") > 0).groupBy("norm").agg(F.max(F.struct(alike.alias("score"), "feature")).alias("top"))
    want = {r.norm: r.top.feature for r in every.collect() if r.top.score >= 0.55}
    assert {r.norm: r.feature for r in mapping.fuzzy_levenshtein(terms, names).collect()} == want and len(want) >= 3


def test_steps_that_keep_whole_requests_stay_in_all_parts(spark, rows):
    matched = mapping.map_symptoms(
        rows("request_id INT, symptoms ARRAY<STRING>", (1, ["cough"]), (1, ["fever"]), (2, None)), tables.features(spark), tables.synonyms(spark), native=True)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert sorted((r.request_id, len(r.matched)) for r in matched.collect()) == [(1, 2), (2, 0)]
