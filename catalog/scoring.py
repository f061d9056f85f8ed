"""Requests: validation, term mapping, severity, ranking, medicines, the whole scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from clinflow.functions import scoring as expressions
from clinflow.functions import text
from clinflow.lookups import language, seeds, tables as lookups
from clinflow.lookups.severity import SEVERITY_WEIGHTS
from clinflow.operators import cleanse, learning, mapping, medicines, ranking
from clinflow.plans import scoring
from clinflow.plans.knowledge import knowledge_lists
from clinflow.session import run_dir
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


# ---- validation -------------------------------------------------------------------------------

LONG_TERM = "x" * 201
RAW_SQL = b.REQUESTS_SQL + f""", entered AS (
  SELECT request_id, CASE WHEN request_id % 11 = 0 THEN '' WHEN request_id % 11 = 1 THEN repeat('a, ', 21)
    WHEN request_id % 11 = 2 THEN 'cough,{LONG_TERM}' ELSE array_to_string(symptoms, ' , ') END AS symptoms,
    CASE WHEN duration_days = 0 THEN NULL WHEN duration_days = 1 THEN 'two' ELSE duration_days::VARCHAR END AS duration_days,
    CASE WHEN age = 7 THEN '3x' WHEN age <> 8 THEN age::VARCHAR END AS age FROM requests),
split AS (SELECT request_id, list_filter(list_transform(string_split(symptoms, ','), lambda s: trim(s)), lambda s: s <> '') AS symptoms,
  duration_days, age FROM entered)"""


def entered(spark, sf):
    request = F.col("request_id") % 11
    symptoms = (
        F.when(request == 0, "").when(request == 1, F.repeat(F.lit("a, "), 21)).when(request == 2, f"cough,{LONG_TERM}")
        .otherwise(F.array_join("symptoms", " , "))
    )
    days = F.when(F.col("duration_days") == 1, "two").when(F.col("duration_days") != 0, F.col("duration_days").cast("string"))
    age = F.when(F.col("age") == 7, "3x").when(F.col("age") != 8, F.col("age").cast("string"))
    return b.requests(spark, sf).select("request_id", symptoms.alias("symptoms"), days.alias("duration_days"), age.alias("age"))


@query("p1_request_validation", f"""WITH {RAW_SQL}
SELECT request_id, array_to_string(symptoms, '|') AS symptoms,
  CASE WHEN duration_days IS NULL THEN 1 ELSE TRY_CAST(duration_days AS INT) END AS duration_days,
  CASE WHEN age IS NULL THEN 30 ELSE TRY_CAST(age AS INT) END AS age,
  CASE WHEN (duration_days IS NOT NULL AND TRY_CAST(duration_days AS INT) IS NULL) OR (age IS NOT NULL AND TRY_CAST(age AS INT) IS NULL)
       THEN 'not an integer'
       WHEN len(symptoms) = 0 THEN 'no symptoms' WHEN len(symptoms) > 20 THEN 'too many symptoms'
       WHEN len(list_filter(symptoms, lambda s: length(s) > 200)) > 0 THEN 'symptom too long' END AS reason
FROM split""")
def p1(spark, sf):
    return cleanse.validate_requests(entered(spark, sf)).withColumn("symptoms", b.bar("symptoms"))


@query("p2_symptom_split", f"WITH {RAW_SQL} SELECT request_id, array_to_string(symptoms, '|') AS symptoms FROM split")
def p2(spark, sf):
    return cleanse.as_terms(entered(spark, sf)).select("request_id", b.bar("symptoms").alias("symptoms"))


FORM = ["Bukhaar", "sar dard ", "khansi", "taiz  bukhaar", "seene mein dard", "unknown", "", "Jism_Dard"]
FORM_MAP = "MAP {" + ", ".join(f"{b.text(k)}: {b.text(v)}" for k, v in language.FORM_TERMS.items()) + "}"


@query("p3_form_split", f"""WITH form AS (
  SELECT event_id, {b.text(FORM)}[event_id % 8 + 1] || ', ' || {b.text(FORM)}[(event_id // 8) % 8 + 1] || ';' || {b.text(FORM)}[(event_id // 64) % 8 + 1] AS t,
    CASE WHEN event_id % 2 = 0 THEN 'ur' ELSE 'en' END AS lang FROM events),
parts AS (SELECT event_id, lang, list_filter(list_transform(string_split_regex(t, '[,\\n;]+'), lambda p: lower(trim(p))), lambda p: p <> '') AS parts FROM form)
SELECT event_id, array_to_string(CASE WHEN lang = 'ur' THEN list_transform(parts,
  lambda p: coalesce({FORM_MAP}[regexp_replace(p, '\\s+', '_', 'g')], {FORM_MAP}[p], p)) ELSE parts END, '|') AS terms FROM parts""")
def p3(spark, sf):
    pick = lambda step: F.get(F.lit(FORM), F.expr(f"CAST(event_id DIV {step} % 8 AS INT)"))
    form = b.table(spark, sf, "events").select(
        "event_id", F.concat(pick(1), F.lit(", "), pick(8), F.lit(";"), pick(64)).alias("t"),
        F.when(F.col("event_id") % 2 == 0, "ur").otherwise("en").alias("lang"),
    )
    return form.select("event_id", b.bar(text.split_form_terms("t", "lang", language.FORM_TERMS)).alias("terms"))


# ---- severity ---------------------------------------------------------------------------------

BASE_SQL = b.REQUESTS_SQL + f""", {b.WEIGHTS_SQL}, {b.BANDS_SQL}, terms AS (
  SELECT request_id, replace(lower(trim(raw)), ' ', '_') AS symptom FROM (SELECT request_id, unnest(symptoms) AS raw FROM requests)),
base AS (SELECT request_id, sum(coalesce(weight, 5))::INT AS base FROM terms LEFT JOIN weights USING (symptom) GROUP BY 1),
severity AS (SELECT request_id, base, least(trunc(base * least(1.0::DOUBLE + duration_days * 0.1::DOUBLE, 2.0::DOUBLE)
  * CASE WHEN age > 60 OR age < 5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)::INT, 100) AS severity
  FROM base JOIN requests USING (request_id)),
risk AS (SELECT request_id, severity, CASE WHEN severity >= 70 THEN 'HIGH' WHEN severity >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM severity)"""


@query("j1_f2_severity", f"WITH {BASE_SQL} SELECT request_id, base, severity FROM severity")
def j1(spark, sf):
    return mapping.weighted_severity(b.requests(spark, sf), lookups.severity_weights(spark))


@query("f2_severity_in_row", f"WITH {BASE_SQL} SELECT request_id, severity FROM severity")
def f2(spark, sf):
    base = expressions.base_weight(F.col("symptoms"), SEVERITY_WEIGHTS)
    return b.requests(spark, sf).select(
        "request_id", expressions.severity_score(base, F.col("duration_days"), F.col("age")).alias("severity")
    )


@query("f3_risk_level", f"""WITH {BASE_SQL} SELECT request_id, severity, risk_level, tests, advice, medicine_type
FROM risk JOIN bands USING (risk_level)""")
def f3(spark, sf):
    out = scoring.with_severity(b.requests(spark, sf), lookups.risk_bands(spark))
    return out.select("request_id", "severity", "risk_level", b.bar("tests").alias("tests"), "advice", "medicine_type")


# ---- term mapping -----------------------------------------------------------------------------

MAP_SQL = b.REQUESTS_SQL + f""", {b.FEATURES_SQL}, {b.SYNONYMS_SQL}, terms AS (
  SELECT DISTINCT raw, replace(lower(trim(raw)), ' ', '_') AS norm FROM (SELECT unnest(symptoms) AS raw FROM requests)),
listed AS (SELECT phrase, coalesce(list(DISTINCT f.feature ORDER BY f.feature) FILTER (f.feature IS NOT NULL), []) AS found
  FROM (SELECT phrase, unnest(features) AS feature FROM synonyms) s LEFT JOIN features f USING (feature) GROUP BY phrase),
single AS (SELECT raw, norm, CASE WHEN norm LIKE '%s' AND length(norm) > 3 THEN rtrim(norm, 's') ELSE norm END AS one FROM terms),
staged AS (SELECT raw, norm, CASE WHEN f.feature IS NOT NULL THEN 'exact' WHEN l.phrase IS NOT NULL THEN 'synonym'
    WHEN f1.feature IS NOT NULL OR l1.phrase IS NOT NULL THEN 'plural' END AS stage,
    CASE WHEN f.feature IS NOT NULL THEN [f.feature] WHEN l.phrase IS NOT NULL THEN l.found
    WHEN f1.feature IS NOT NULL THEN [f1.feature] WHEN l1.phrase IS NOT NULL THEN l1.found END AS found
  FROM single LEFT JOIN features f ON f.feature = norm LEFT JOIN listed l ON l.phrase = norm
  LEFT JOIN features f1 ON f1.feature = one LEFT JOIN listed l1 ON l1.phrase = one),
near AS (SELECT raw, feature, 1.0::DOUBLE - levenshtein(norm, feature)::DOUBLE / greatest(length(norm), length(feature)) AS score
  FROM staged, features WHERE stage IS NULL),
close AS (SELECT raw, max((score, feature)) AS top FROM near GROUP BY raw HAVING max(score) >= 0.55)"""

EXTRACT_SQL = """, phrases AS (SELECT DISTINCT replace(p, '_', ' ') AS phrase FROM (SELECT feature AS p FROM features UNION ALL SELECT phrase FROM synonyms))"""


def pull_sql(source: str) -> str:
    """Recursive form of the phrase extraction over (raw) rows of `source`."""
    return f""", pulled AS (
  SELECT raw, trim(lower(raw)) AS rest, 0 AS n, NULL::VARCHAR AS phrase FROM (SELECT DISTINCT raw FROM {source})
  UNION ALL
  SELECT raw, trim(regexp_replace(left(rest, strpos(rest, hit) - 1) || ' ' || substr(rest, strpos(rest, hit) + length(hit)), '\\s+', ' ', 'g')), n + 1, hit
  FROM (SELECT raw, rest, n, (SELECT phrase FROM phrases WHERE contains(rest, phrase) ORDER BY length(phrase) DESC, phrase LIMIT 1) AS hit FROM pulled)
  WHERE hit IS NOT NULL)"""


FULL_MAP_SQL = MAP_SQL + EXTRACT_SQL + ", open AS (SELECT raw FROM staged LEFT JOIN close USING (raw) WHERE stage IS NULL AND top IS NULL)" + pull_sql("open") + """,
meaning AS (SELECT phrases.phrase, CASE WHEN f.feature IS NOT NULL THEN [f.feature] ELSE l.found END AS found
  FROM phrases LEFT JOIN features f ON f.feature = replace(phrases.phrase, ' ', '_') LEFT JOIN listed l ON l.phrase = replace(phrases.phrase, ' ', '_')),
extracted AS (SELECT raw, list_sort(list_distinct(flatten(list(found)))) AS got FROM pulled JOIN meaning USING (phrase) GROUP BY raw),
resolved AS (SELECT raw, CASE WHEN stage IS NOT NULL THEN stage WHEN top IS NOT NULL THEN 'fuzzy' WHEN got IS NOT NULL THEN 'extracted' ELSE 'unmatched' END AS stage,
  CASE WHEN stage IS NOT NULL THEN found WHEN top IS NOT NULL THEN [top[2]] WHEN got IS NOT NULL THEN got ELSE [] END AS features
  FROM staged LEFT JOIN close USING (raw) LEFT JOIN extracted USING (raw)),
matched AS (SELECT request_id, list_sort(list_distinct(flatten(list(features)))) AS matched
  FROM (SELECT request_id, unnest(symptoms) AS raw FROM requests) JOIN resolved USING (raw) GROUP BY request_id)"""
FULL_MAP_SQL = FULL_MAP_SQL.replace("logs AS (", "RECURSIVE logs AS (", 1).lstrip()


def resolved(spark, sf, native=True):
    terms = mapping.exploded_terms(b.requests(spark, sf))
    return terms, mapping.resolve_terms(terms, lookups.features(spark), lookups.synonyms(spark), native=native)


def matched(spark, sf):
    return mapping.map_symptoms(b.requests(spark, sf), lookups.features(spark), lookups.synonyms(spark), native=True)


@query("j2_term_resolution", f"WITH {FULL_MAP_SQL} SELECT raw, stage, array_to_string(features, '|') AS features FROM resolved")
def j2(spark, sf):
    return resolved(spark, sf)[1].withColumn("features", b.bar("features"))


@query("j2_symptom_mapping", f"WITH {FULL_MAP_SQL} SELECT request_id, {b.joined('matched')} AS matched FROM matched")
def j2_map(spark, sf):
    return matched(spark, sf).withColumn("matched", b.bar("matched"))


def entered_norms(spark, sf):
    return mapping.exploded_terms(b.requests(spark, sf)).select(text.normalise_term("raw").alias("norm")).distinct()


@query("j3_fuzzy_levenshtein", f"""WITH {b.REQUESTS_SQL}, {b.FEATURES_SQL}, terms AS (
  SELECT DISTINCT replace(lower(trim(raw)), ' ', '_') AS norm FROM (SELECT unnest(symptoms) AS raw FROM requests)),
near AS (SELECT norm, feature, 1.0::DOUBLE - levenshtein(norm, feature)::DOUBLE / greatest(length(norm), length(feature)) AS score FROM terms, features),
best AS (SELECT norm, max((score, feature)) AS top FROM near GROUP BY norm HAVING max(score) >= 0.55)
SELECT norm, top[2] AS feature, {b.rounded('top[1]', 4)} AS score FROM best""")
def j3(spark, sf):
    return mapping.fuzzy_levenshtein(entered_norms(spark, sf), lookups.features(spark))


# The matching blocks of difflib: the longest common part, first in the name, then in the term; then both sides of it.
LONGEST_SQL = """list_filter(flatten(list_transform(range(least(length(x), length(y)), 0, -1), lambda k: list_transform(range(1, length(x) - k + 2),
  lambda i: {'k': k, 'i': i}))), lambda p: contains(y, substr(x, p.i, p.k)))[1]"""


@query("j3_fuzzy_ratio", f"""WITH RECURSIVE {b.REQUESTS_SQL.strip()}, {b.FEATURES_SQL}, terms AS (
  SELECT DISTINCT replace(lower(trim(raw)), ' ', '_') AS norm FROM (SELECT unnest(symptoms) AS raw FROM requests)),
parts AS (SELECT norm, feature, feature AS x, norm AS y FROM terms, features WHERE norm <> ''
  UNION ALL SELECT norm, feature, s.x, s.y FROM (SELECT norm, feature, unnest([
      {{'x': substr(x, 1, p.i - 1), 'y': substr(y, 1, strpos(y, substr(x, p.i, p.k)) - 1)}},
      {{'x': substr(x, p.i + p.k), 'y': substr(y, strpos(y, substr(x, p.i, p.k)) + p.k)}}]) AS s
    FROM (SELECT *, {LONGEST_SQL} AS p FROM parts) WHERE p IS NOT NULL) WHERE s.x <> '' AND s.y <> ''),
ratios AS (SELECT norm, feature, 2.0::DOUBLE * sum(coalesce(p.k, 0)) / (length(norm) + length(feature)) AS score
  FROM (SELECT *, {LONGEST_SQL} AS p FROM parts) GROUP BY norm, feature),
best AS (SELECT norm, max((score, feature)) AS top FROM ratios GROUP BY norm HAVING max(score) >= 0.55)
SELECT norm, top[2] AS feature, {b.rounded('top[1]', 6)} AS score FROM best""")
def j3_ratio(spark, sf):
    return mapping.fuzzy_ratio(entered_norms(spark, sf), lookups.features(spark)).withColumn("score", F.round("score", 6))


MESSAGE_TEXTS_SQL = "RECURSIVE " + b.MESSAGES_SQL.strip() + f", {b.FEATURES_SQL}, {b.SYNONYMS_SQL}, texts AS (SELECT DISTINCT content AS raw FROM messages)"


@query("j4_phrase_extraction", f"""WITH {MESSAGE_TEXTS_SQL}{EXTRACT_SQL}{pull_sql('texts')}
SELECT raw, coalesce(string_agg(phrase, '|' ORDER BY n), '') AS found FROM pulled GROUP BY raw""")
def j4(spark, sf):
    phrases = mapping.known_phrases(lookups.features(spark), lookups.synonyms(spark))
    texts = b.messages(spark, sf).select(F.col("content").alias("raw")).distinct()
    return mapping.extract_phrases(texts, phrases).select("raw", b.bar("found").alias("found"))


@query("j5_unmatched_terms", f"""WITH {FULL_MAP_SQL} SELECT raw, count(*) AS n
FROM (SELECT unnest(symptoms) AS raw FROM requests) JOIN resolved USING (raw) WHERE stage = 'unmatched' GROUP BY raw""")
def j5(spark, sf):
    return mapping.unmatched_terms(*resolved(spark, sf))


@query("f19_feature_vector", f"""WITH {b.REQUESTS_SQL}, {b.FEATURES_SQL}, t AS (
  SELECT request_id, list_transform(symptoms, lambda s: replace(lower(trim(s)), ' ', '_')) AS t FROM requests)
SELECT request_id, array_to_string(list_transform({b.text(seeds.FEATURES)}, lambda f: list_contains(t, f)::INT), '|') AS vector FROM t""")
def f19(spark, sf):
    return mapping.feature_vector(b.requests(spark, sf), seeds.FEATURES).select("request_id", b.bar("vector").alias("vector"))


@query("u4_set_algebra", f"""WITH {b.REQUESTS_SQL}, {b.DISEASES_SQL}, t AS (
  SELECT request_id, list_distinct(list_transform(symptoms, lambda s: replace(lower(trim(s)), ' ', '_'))) AS t FROM requests)
SELECT request_id, disease, len(list_filter(features, lambda f: list_contains(t, f))) AS shared,
  list_has_all(features, t) AS inside FROM t, diseases WHERE list_has_any(features, t)""")
def u4(spark, sf):
    terms = b.requests(spark, sf).select("request_id", F.array_distinct(F.transform("symptoms", text.normalise_term)).alias("t"))
    by_term = terms.select("*", F.explode("t").alias("feature"))
    diseases = lookups.disease_features(spark)
    held = diseases.select("disease", "features", F.explode("features").alias("feature"))
    return by_term.join(held, "feature").dropDuplicates(["request_id", "disease"]).select(
        "request_id", "disease", F.size(F.array_intersect("t", "features")).alias("shared"),
        (F.size(F.array_except("t", "features")) == 0).alias("inside"),
    )


# ---- ranking ----------------------------------------------------------------------------------

OVERLAP_SQL = FULL_MAP_SQL + f""", {b.DISEASES_SQL}, known AS (SELECT disease, len(features) AS known, unnest(features) AS feature FROM diseases),
shared AS (SELECT request_id, disease, count(*) AS overlap, any_value(len(matched)) AS wanted, any_value(known) AS known
  FROM (SELECT request_id, matched, unnest(matched) AS feature FROM matched) JOIN known USING (feature) GROUP BY 1, 2),
ratio AS (SELECT *, overlap::DOUBLE / wanted AS p, overlap::DOUBLE / known AS r FROM shared),
f AS (SELECT request_id, disease, overlap, {b.rounded('2.0::DOUBLE * (p * r) / (p + r)', 4)} AS confidence, 2.0::DOUBLE * (p * r) / (p + r) AS exact FROM ratio),
overlap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, overlap DESC, disease) AS pos FROM f) WHERE pos <= 10)"""
MODEL_SQL = b.SCORES_SQL + f""", model AS (SELECT request_id, disease, {b.rounded('probability', 4)} AS confidence, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY probability DESC, disease) AS pos FROM scores WHERE probability > 0) WHERE pos <= 10)"""
BLEND_SQL = OVERLAP_SQL + ", " + MODEL_SQL.strip() + f""", both_sides AS (
  SELECT coalesce(o.request_id, m.request_id) AS request_id, coalesce(o.disease, m.disease) AS disease,
    coalesce(o.confidence * 0.7::DOUBLE, 0) + coalesce(m.confidence * 0.3::DOUBLE, 0) AS score, o.pos AS o, m.pos AS m
  FROM overlap o FULL OUTER JOIN (SELECT * FROM model WHERE request_id IN (SELECT request_id FROM matched WHERE len(matched) > 0)) m ON o.request_id = m.request_id AND o.disease = m.disease),
ranked AS (SELECT request_id, disease, {b.rounded('score', 4)} AS confidence, score,
  row_number() OVER (PARTITION BY request_id ORDER BY score DESC, o ASC NULLS LAST, m ASC NULLS LAST) AS rank FROM both_sides),
blend AS (SELECT request_id, disease, confidence, rank FROM ranked WHERE rank <= 3 AND score > 0)"""


@query("j6_overlap_scores", f"WITH {OVERLAP_SQL} SELECT request_id, disease, confidence, overlap, pos FROM overlap")
def j6(spark, sf):
    return ranking.overlap_scores(matched(spark, sf), lookups.disease_features(spark))


@query("e4_top_probabilities", f"WITH {MODEL_SQL} SELECT request_id, disease, confidence, pos FROM model")
def e4(spark, sf):
    return ranking.top_probabilities(b.model_scores(spark, sf))


@query("j7_blended_ranking", f"WITH {BLEND_SQL} SELECT * FROM blend")
def j7(spark, sf):
    return scoring.blended(matched(spark, sf), lookups.disease_features(spark), b.model_scores(spark, sf))


VIGNETTE_SQL = OVERLAP_SQL + ", " + b.SCORES_SQL.strip() + f""", expected AS (SELECT request_id, {b.text(b.DISEASES)}[request_id % {len(b.DISEASES)} + 1] AS name FROM requests),
parts AS (SELECT request_id, disease, exact * 0.7::DOUBLE AS part, 0 AS side FROM f UNION ALL SELECT request_id, disease, probability * 0.3::DOUBLE, 1 FROM scores),
sums AS (SELECT request_id, disease, coalesce(max(part) FILTER (side = 0), 0) + coalesce(max(part) FILTER (side = 1), 0) AS score FROM parts GROUP BY 1, 2),
best AS (SELECT request_id, disease FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, disease) AS rn FROM sums) WHERE rn = 1),
judged AS (SELECT name, lower(name) AS a, lower(disease) AS b FROM expected JOIN best USING (request_id))
SELECT name AS expected, count(*) FILTER (hit) AS passed, count(*) FILTER (NOT hit) AS failed FROM (
  SELECT name, contains(b, a) OR contains(a, b) OR contains(b, string_split(a, ' ')[1]) OR contains(a, string_split(b, ' ')[1]) AS hit FROM judged) GROUP BY 1"""


@query("a15_vignette_evaluation", f"WITH {VIGNETTE_SQL}")
def a15(spark, sf):
    features = ranking.overlap_scores(matched(spark, sf), lookups.disease_features(spark), top=None, places=None)
    best = learning.blend_unrounded(
        features.withColumnRenamed("confidence", "score"), b.model_scores(spark, sf), "request_id", top=1
    )
    names = F.lit(b.DISEASES)
    expected = b.requests(spark, sf).select(
        "request_id", F.get(names, (F.col("request_id") % len(b.DISEASES)).cast("int")).alias("expected")
    )
    judged = expected.join(best, "request_id").withColumn("passed", learning.is_hit(F.col("expected"), F.col("disease")))
    return judged.groupBy("expected").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


# ---- medicines --------------------------------------------------------------------------------

TIERS_SQL = b.DRUGS_SQL + f""", {b.SEED_DRUGS_SQL}, tiers AS (
  SELECT tier, disease, coalesce(list(drug_name ORDER BY pos) FILTER (drug_type = 'otc'), []) AS otc,
    coalesce(list(drug_name ORDER BY pos) FILTER (drug_type = 'prescription'), []) AS rx
  FROM (SELECT disease, drug_name, drug_type, tier, min(pos) AS pos FROM (
    SELECT disease, drug_name, drug_type, pos, tier FROM drugs WHERE tier < 2 UNION ALL SELECT *, 2 FROM seed_drugs) GROUP BY ALL) GROUP BY 1, 2)"""
ASKED_SQL = """asked AS (SELECT l_orderkey, l_linenumber, p_type || ' ' || CASE WHEN l_linenumber = 3 THEN 'none' ELSE p_brand END AS disease,
  CASE WHEN l_linenumber % 2 = 0 THEN 'otc' ELSE 'prescription' END AS medicine_type FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def tier_tables(spark, sf):
    drugs = b.drugs(spark, sf)
    return [
        ("postgresql", medicines.tier_lists(drugs.filter("tier = 0"), "pos")),
        ("openfda_cache", medicines.tier_lists(drugs.filter("tier = 1"), "pos")),
        ("static", medicines.tier_lists(lookups.medicines(spark), "pos")),
    ]


@query("j8_medicine_tiers", f"""WITH {TIERS_SQL}, {ASKED_SQL}, chosen AS (
  SELECT disease, min_by((otc, rx, tier), tier) AS m FROM tiers GROUP BY 1),
filled AS (SELECT l_orderkey, l_linenumber, disease, medicine_type, coalesce(m[1], {b.text(seeds.DEFAULT_OTC)}) AS otc,
  coalesce(m[2], {b.text(seeds.DEFAULT_PRESCRIPTION)}) AS rx, coalesce(['postgresql', 'openfda_cache', 'static'][m[3] + 1], 'static') AS source
  FROM asked LEFT JOIN chosen USING (disease))
SELECT l_orderkey, l_linenumber, disease, medicine_type, {b.joined('otc')} AS otc, {b.joined('rx')} AS prescription,
  {b.joined("CASE WHEN medicine_type = 'otc' THEN otc ELSE rx END")} AS recommended, source FROM filled""")
def j8(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    asked = b.table(spark, sf, "lineitem").join(part, "l_partkey").select(
        "l_orderkey", "l_linenumber",
        F.concat("p_type", F.lit(" "), F.when(F.col("l_linenumber") == 3, "none").otherwise(F.col("p_brand"))).alias("disease"),
        F.when(F.col("l_linenumber") % 2 == 0, "otc").otherwise("prescription").alias("medicine_type"),
    )
    out = medicines.suggest_medicines(asked, tier_tables(spark, sf))
    return out.select(
        "l_orderkey", "l_linenumber", "disease", "medicine_type", *[b.bar(c).alias(c) for c in ("otc", "prescription", "recommended")], "source"
    )


@query("e11_first_wins", f"""WITH {b.DRUGS_SQL} SELECT disease, drug_name, drug_type, pos, tier FROM (
  SELECT *, row_number() OVER (PARTITION BY disease, drug_name ORDER BY tier, pos) AS rn FROM drugs) WHERE rn = 1""")
def e11(spark, sf):
    drugs = b.drugs(spark, sf)
    return medicines.first_wins([(t, drugs.filter(F.col("tier") == t).drop("tier")) for t in (0, 1, 2)])


@query("k2_insert_if_absent", f"""WITH {b.DRUGS_SQL} SELECT disease, drug_name, drug_type, pos FROM drugs
WHERE tier > 0 AND (disease, drug_name) NOT IN (SELECT (disease, drug_name) FROM drugs WHERE tier = 0)""")
def k2(spark, sf):
    drugs = b.drugs(spark, sf)
    return medicines.new_drugs(drugs.filter("tier > 0").drop("tier"), drugs.filter("tier = 0"))


LABELS_SQL = """labels_raw AS (SELECT p_partkey, [' ' || p_name || ' ', p_brand] AS brand, [lower(p_type)] AS generic,
  CASE WHEN p_size % 2 = 0 THEN [p_name || ' forte', p_type || ' salt'] END AS substance, 'For ' || p_type || ' and ' || p_name || ', see ' || p_brand AS indication FROM part),
names AS (SELECT p_partkey, indication, list_sort(list_distinct(list_transform(list_concat(brand, generic, coalesce(substance, [])),
  lambda n: array_to_string(list_transform(string_split(trim(n), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')))) AS all_names FROM labels_raw),
label_names AS (SELECT p_partkey, indication, all_names AS names FROM names)"""


def drug_labels(spark, sf):
    substance = F.when(F.col("p_size") % 2 == 0, F.array(F.concat("p_name", F.lit(" forte")), F.concat("p_type", F.lit(" salt"))))
    raw = b.table(spark, sf, "part").select(
        "p_partkey",
        F.struct(
            F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), "p_brand").alias("brand_name"),
            F.array(F.lower("p_type")).alias("generic_name"), substance.alias("substance_name"),
        ).alias("openfda"),
        F.array(F.concat(F.lit("For "), "p_type", F.lit(" and "), "p_name", F.lit(", see "), "p_brand")).alias("indications_and_usage"),
    )
    return medicines.label_names(raw)


@query("s10_label_names", f"WITH {LABELS_SQL} SELECT p_partkey, array_to_string(names, '|') AS names, left(indication, 200) AS description FROM label_names")
def s10(spark, sf):
    return drug_labels(spark, sf).select("p_partkey", b.bar("names").alias("names"), "description")


@query("j12_label_drugs", f"""WITH {LABELS_SQL}, terms AS (
  SELECT p_type AS disease, unnest([p_type || ' and small', 'brand#1', 'ring']) AS term, unnest([0, 1, 2]) AS pos FROM (SELECT DISTINCT p_type FROM part)),
kept AS (SELECT lower(term) AS t, p_partkey FROM (SELECT DISTINCT term FROM terms), label_names WHERE contains(lower(indication), lower(term)))
SELECT disease, unnest(names) AS drug_name, 'prescription' AS drug_type, left(indication, 200) AS description, pos AS term_pos,
  p_partkey AS label_pos, unnest(range(0, len(names))) AS name_pos
FROM kept JOIN terms ON t = lower(term) JOIN label_names USING (p_partkey)""")
def j12(spark, sf):
    terms = b.table(spark, sf, "part").select(F.col("p_type").alias("disease")).distinct().select(
        "disease", F.posexplode(F.array(F.concat("disease", F.lit(" and small")), F.lit("brand#1"), F.lit("ring"))).alias("pos", "term")
    )
    return medicines.label_drugs(drug_labels(spark, sf), terms, "p_partkey")


# ---- the whole scoring ------------------------------------------------------------------------

SEED_TIER_SQL = b.SEED_DRUGS_SQL + """, seed_lists AS (SELECT disease, coalesce(list(drug_name ORDER BY pos) FILTER (drug_type = 'otc'), []) AS otc,
  coalesce(list(drug_name ORDER BY pos) FILTER (drug_type = 'prescription'), []) AS rx FROM seed_drugs GROUP BY 1)"""
SCORED_SQL = BLEND_SQL + ", " + SEED_TIER_SQL + f""", {b.BANDS_SQL}, {b.WEIGHTS_SQL}, weighted AS (
  SELECT request_id, sum(coalesce(weight, 5))::INT AS base FROM (SELECT request_id, replace(lower(trim(raw)), ' ', '_') AS symptom
    FROM (SELECT request_id, unnest(symptoms) AS raw FROM requests)) LEFT JOIN weights USING (symptom) GROUP BY 1),
sev AS (SELECT request_id, user_id, symptoms, duration_days, age, least(trunc(base * least(1.0::DOUBLE + duration_days * 0.1::DOUBLE, 2.0::DOUBLE)
  * CASE WHEN age > 60 OR age < 5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)::INT, 100) AS severity FROM weighted JOIN requests USING (request_id)),
risk AS (SELECT *, CASE WHEN severity >= 70 THEN 'HIGH' WHEN severity >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM sev),
lists AS (SELECT request_id, list(disease ORDER BY rank) AS ds, list(confidence ORDER BY rank) AS cs FROM blend GROUP BY 1),
size AS (SELECT count(*) AS n FROM embeddings),
asked AS (SELECT disease, embedding FROM (SELECT *, row_number() OVER (ORDER BY disease) - 1 AS i FROM diseases), size JOIN embeddings ON vec_id = i % n),
far AS (SELECT q.disease, i.vec_id, list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance
  FROM asked q, embeddings i),
closest AS (SELECT f.disease, d.lang, d.text, row_number() OVER (PARTITION BY f.disease ORDER BY distance, doc_id) AS rank
  FROM documents d, size JOIN far f ON f.vec_id = d.doc_id % n),
knowledge AS (SELECT disease, list(coalesce(lang, 'Unknown') ORDER BY rank) AS ks, list(text ORDER BY rank) AS content FROM closest WHERE rank <= 3 GROUP BY 1),
scored AS (SELECT request_id, user_id, symptoms, severity, risk_level, tests, advice, ds, cs, coalesce(ds[1], 'Unknown') AS top_disease,
  coalesce(s.otc, {b.text(seeds.DEFAULT_OTC)}) AS otc, coalesce(s.rx, {b.text(seeds.DEFAULT_PRESCRIPTION)}) AS rx, medicine_type, ks, content
  FROM risk JOIN bands USING (risk_level) LEFT JOIN lists USING (request_id)
  LEFT JOIN seed_lists s ON s.disease = coalesce(ds[1], 'Unknown') LEFT JOIN knowledge k ON k.disease = coalesce(ds[1], 'Unknown'))"""


def scored(spark, sf):
    """Scored requests with the three documents nearest to each disease; a disease asks with a vector of its own."""
    vectors = b.table(spark, sf, "embeddings")
    names = lookups.values_table(spark, ["query_id", "i"], [(d, i) for i, d in enumerate(sorted(b.DISEASES))])
    asked = names.withColumn("vec_id", F.col("i") % vectors.agg(F.count("*")).scalar()).join(vectors, "vec_id")
    knowledge = knowledge_lists(asked.select("query_id", F.col("embedding").alias("vector")), b.document_chunks(spark, sf))
    held = scoring.Lookups(
        lookups.features(spark), lookups.synonyms(spark), lookups.disease_features(spark), lookups.risk_bands(spark),
        [("static", medicines.tier_lists(lookups.medicines(spark), "pos"))], knowledge,
    )
    return scoring.score_requests(b.requests(spark, sf), held, b.model_scores(spark, sf), native=True)


PAIRS = "array_to_string(list_transform(range(1, len(ds) + 1), lambda i: ds[i] || '=' || printf('%.4f', cs[i])), '|')"


def pairs(column):
    return b.bar(F.transform(column, lambda p: F.format_string("%s=%.4f", p["disease"], p["confidence"])))


@query("j11_scored_requests", f"""WITH {SCORED_SQL} SELECT request_id, coalesce({PAIRS}, '') AS predictions, severity, risk_level, tests, advice, top_disease,
  {b.joined('otc')} AS otc, {b.joined('rx')} AS prescription, {b.joined("CASE WHEN medicine_type = 'otc' THEN otc ELSE rx END")} AS recommended,
  coalesce(array_to_string(list_transform(range(1, len(content) + 1), lambda i: ks[i] || ':' || content[i]), '|'), '') AS knowledge FROM scored""")
def j11(spark, sf):
    out = scored(spark, sf)
    return out.select(
        "request_id", pairs("predictions").alias("predictions"), "severity", "risk_level", b.bar("tests").alias("tests"), "advice", "top_disease",
        *[b.bar(c).alias(c) for c in ("otc", "prescription", "recommended")],
        b.bar(F.transform("knowledge", lambda k: F.concat(k["disease"], F.lit(":"), k["content"]))).alias("knowledge"),
    )


@query("p10_response", f"""WITH {SCORED_SQL} SELECT request_id, coalesce({PAIRS}, '') AS predictions, severity AS severity_score, risk_level, top_disease AS disease,
  coalesce(array_to_string(list_transform(range(1, len(content) + 1), lambda i: ks[i] || ':' || left(content[i], 300)), '|'), '') AS knowledge FROM scored""")
def p10(spark, sf):
    out = scoring.responses(scored(spark, sf))
    return out.select(
        "request_id", pairs("predictions").alias("predictions"), "risk.severity_score", "risk.risk_level", "medicines.disease",
        b.bar(F.transform("rag_knowledge", lambda k: F.concat(k["disease"], F.lit(":"), k["content"]))).alias("knowledge"),
    )


LINES = "array_to_string(list_transform(range(1, len(ds) + 1), lambda i: '  ' || i || '. ' || ds[i] || ' (' || printf('%.1f', " + b.rounded("cs[i] * 100::DOUBLE", 1) + ") || '%)'), chr(10))"


@query("f20_advisory_text", f"""WITH {SCORED_SQL} SELECT request_id, array_to_string(['Top predicted conditions:', coalesce({LINES}, ''),
  'Risk level: ' || risk_level || ' (severity score ' || severity || '/100)', 'Advice: ' || advice, 'Knowledge:',
  coalesce(array_to_string(list_transform(content[1:2], lambda c: left(c, 200)), chr(10)), 'No additional context.'),
  'OTC medicines: ' || CASE WHEN len(otc) > 0 THEN array_to_string(otc[1:3], ', ') ELSE 'see a pharmacist' END,
  'Prescription medicines: ' || CASE WHEN len(rx) > 0 THEN array_to_string(rx[1:2], ', ') ELSE 'consult a doctor' END], chr(10)) AS request_text FROM scored""")
def f20(spark, sf):
    return scoring.advisory_requests(scored(spark, sf))


@query("k5_prediction_log", f"""WITH {SCORED_SQL} SELECT request_id AS log_id, user_id, array_to_string(symptoms, ', ') AS raw_text, top_disease,
  coalesce({PAIRS}, '') AS predictions, severity, severity AS severity_score, risk_level FROM scored""")
def k5(spark, sf):
    records = tables.log_records(scored(spark, sf), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    return records.select("log_id", "user_id", "raw_text", "top_disease", pairs("predictions").alias("predictions"),
                          "severity", "severity_score", "risk_level")


@query("k6_audit_rows", f"""WITH {SCORED_SQL} SELECT 'predict' AS event_type, user_id::VARCHAR AS user_id, array_to_string(symptoms, '|') AS symptoms,
  top_disease, severity, CASE WHEN severity >= 70 THEN 'HIGH' WHEN severity >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM scored""")
def k6(spark, sf):
    rows = tables.audit_records(scored(spark, sf), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    payload = F.from_json("payload", "symptoms ARRAY<STRING>, top_disease STRING, risk_level STRING, severity INT")
    return rows.withColumn("p", payload).select(
        "event_type", "user_id", b.bar("p.symptoms").alias("symptoms"), "p.top_disease", "p.severity", "p.risk_level"
    )


TOPIC_SQL = f"""WITH {b.REQUESTS_SQL} SELECT 'symptom-input' AS topic, user_id::VARCHAR AS key,
  '{{"request_id":' || request_id || ',"user_id":' || user_id || ',"symptoms":' || to_json(symptoms) || ',"duration_days":' || duration_days || ',"age":' || age || '}}' AS value FROM requests"""


@query("k7_topic_records", TOPIC_SQL)
def k7(spark, sf):
    rows = b.requests(spark, sf).select("request_id", "user_id", "symptoms", "duration_days", "age")
    return tables.topic_records(rows, "symptom-input", "user_id")


@query("k7_published", TOPIC_SQL)
def k7_published(spark, sf):
    """What a sink holds after the records were sent to it; JSON files stand for the broker."""
    folder = run_dir(spark, "topics")
    tables.publish(k7(spark, sf), "json", path=folder)
    return spark.read.schema("topic STRING, key STRING, value STRING").json(folder)


# ---- matrices ---------------------------------------------------------------------------------

def raw_matrix(spark, sf):
    return b.logs(spark, sf).select(
        F.when(F.col("duration_days") % 2 == 0, "1").when(F.col("duration_days") % 3 == 0, "0").alias(" Itching"),
        F.when(F.col("age") % 3 == 0, "1").otherwise("0").alias("Skin Rash "),
        F.lit("x").alias("Unnamed: 2"),
        F.when(F.col("severity") > 50, "1").alias("High Fever"),
        F.concat(F.lit("  "), "top_disease", F.lit(" ")).alias("Prognosis"),
    )


MATRIX_SQL = b.LOGS_SQL + """, m AS (SELECT log_id, CASE WHEN duration_days % 2 = 0 THEN 1 ELSE 0 END AS itching, CASE WHEN age % 3 = 0 THEN 1 ELSE 0 END AS skin_rash,
  CASE WHEN severity > 50 THEN 1 ELSE 0 END AS high_fever, top_disease AS label FROM logs)"""


@query("s3_symptom_matrix", f"WITH {MATRIX_SQL} SELECT itching, skin_rash, high_fever, label, count(*) AS n FROM m GROUP BY ALL")
def s3(spark, sf):
    clean = matrix.clean_matrix(raw_matrix(spark, sf))
    return clean.groupBy(*clean.columns).agg(F.count("*").alias("n"))


@query("s4_matrix_alignment", f"""WITH {MATRIX_SQL} SELECT high_fever, 0 AS cough, itching, '  ' || label || ' ' AS label, count(*) AS n FROM m GROUP BY ALL""")
def s4(spark, sf):
    aligned = matrix.align_matrix(raw_matrix(spark, sf).na.fill("0"), ["high_fever", "cough", "itching"])
    cast = aligned.select(*[F.col(c).cast("int").alias(c) for c in aligned.columns if c != "label"], "label")
    return cast.groupBy(*cast.columns).agg(F.count("*").alias("n"))


@query("a9_disease_map", f"""WITH {b.REQUESTS_SQL}, {b.FEATURES_SQL}, t AS (
  SELECT l.top_disease AS disease, replace(lower(trim(raw)), ' ', '_') AS feature FROM (SELECT top_disease, unnest(symptoms) AS raw FROM logs) l)
SELECT disease, string_agg(feature, '|' ORDER BY pos) AS features FROM (SELECT DISTINCT disease, feature, pos FROM t JOIN features USING (feature)) GROUP BY 1""")
def a9(spark, sf):
    rows = b.logs(spark, sf)
    vectors = mapping.feature_vector(rows, seeds.FEATURES)
    wide = vectors.select(*[F.get("vector", F.lit(i)).alias(name) for i, name in enumerate(seeds.FEATURES)], F.col("top_disease").alias("label"))
    return matrix.disease_symptoms(wide).select("disease", b.bar("features").alias("features"))


@query("k10_disease_map_json", f"""WITH {MATRIX_SQL}, d AS (SELECT label AS disease, sum(itching) AS a, sum(skin_rash) AS s, sum(high_fever) AS h FROM m GROUP BY 1)
SELECT disease, array_to_string(list_filter([CASE WHEN a > 0 THEN 'itching' END, CASE WHEN s > 0 THEN 'skin_rash' END, CASE WHEN h > 0 THEN 'high_fever' END],
  lambda x: x IS NOT NULL), '|') AS features FROM d""")
def k10(spark, sf):
    from clinflow.session import run_dir

    path = run_dir(spark, "disease-map")
    tables.write_disease_map(matrix.disease_symptoms(matrix.clean_matrix(raw_matrix(spark, sf))), path)
    return spark.read.schema("disease STRING, features ARRAY<STRING>").json(path).withColumn("features", b.bar("features"))


@query("a10_dataset_profile", f"""WITH {MATRIX_SQL} SELECT count(*) AS rows, 3 AS features, count(DISTINCT label) AS classes,
  array_to_string(list_sort(list(DISTINCT label)), '|') AS labels FROM m""")
def a10(spark, sf):
    return matrix.profile(matrix.clean_matrix(raw_matrix(spark, sf))).withColumn("labels", b.bar("labels"))


@query("a9_long_form", f"""WITH {MATRIX_SQL} SELECT label, feature, sum(value) AS total FROM (
  UNPIVOT (SELECT itching, skin_rash, high_fever, label FROM m) ON itching, skin_rash, high_fever INTO NAME feature VALUE value) GROUP BY ALL""")
def a9_long(spark, sf):
    rows = matrix.long_form(matrix.clean_matrix(raw_matrix(spark, sf)))
    return rows.groupBy("label", "feature").agg(F.sum("value").alias("total"))
