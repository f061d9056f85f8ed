"""Entered terms to model features.

Free-text terms repeat a lot, so every costly step runs once per distinct term; only the
finished (term, features) pairs are joined back to the requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.batched import best_ratio
from clinflow.functions.scoring import severity_score
from clinflow.functions.text import let, normalise_term, strip
from clinflow.lookups.severity import UNKNOWN_WEIGHT
from clinflow.operators.containment import possible
from clinflow.operators.joining import by_key, first, lookup_join

FUZZY_CUTOFF = 0.55
#: Parts of the names of one length, so that a list of candidates stays short.
PARTS = 32


def exploded_terms(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, raw term) rows; requests without terms drop out."""
    return requests.select(key, F.explode("symptoms").alias("raw"))


def weighted_severity(requests: DataFrame, weights: DataFrame, key: str = "request_id") -> DataFrame:
    """J1 + F2 with the weights as a table: key, base, severity."""
    # Outer: a request without terms keeps a row, so one aggregate gives every request.
    terms = requests.select(key, "duration_days", "age", F.posexplode_outer("symptoms").alias("at", "raw"))
    known = lookup_join(terms.withColumn("symptom", normalise_term("raw")), weights, ["symptom"], "left", spread=[key, "at"])
    weight = F.when(F.col("symptom").isNotNull(), F.coalesce("weight", F.lit(UNKNOWN_WEIGHT)))
    sums = known.groupBy(key).agg(
        F.coalesce(F.sum(weight), F.lit(0)).cast("int").alias("base"),
        F.first("duration_days").alias("duration_days"), F.first("age").alias("age"),
    )
    return sums.select(key, "base", severity_score(F.col("base"), F.col("duration_days"), F.col("age")).alias("severity"))


def dictionary(features: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(norm, stage, features): what a normalised term means as a feature or as a listed phrase.

    A listed phrase counts even when none of its features is known: it ends the search.
    """
    exact = features.select(F.col("feature").alias("norm"), F.lit("exact").alias("stage"), F.array("feature").alias("features"))
    parts = synonyms.select("phrase", F.explode_outer("features").alias("feature")).join(
        features.select("feature", F.col("feature").alias("_known")), "feature", "left"
    )
    listed = parts.groupBy("phrase").agg(F.array_sort(F.collect_set("_known")).alias("features")).select(
        F.col("phrase").alias("norm"), F.lit("synonym").alias("stage"), "features"
    )
    return first(exact.unionByName(listed), ["norm"], F.col("stage"))


def _stage(terms: DataFrame, meanings: DataFrame) -> DataFrame:
    """Exact, synonym and plural stages: adds stage and features to distinct `norm` terms."""
    norm = F.col("norm")
    single = F.when(norm.endswith("s") & (F.length(norm) > 3), F.rtrim(norm, F.lit("s")))
    plural = meanings.select(F.col("norm").alias("_single"), F.col("features").alias("_plural"))
    rows = lookup_join(terms.withColumn("_single", single), meanings, ["norm"])
    rows = lookup_join(rows, plural, ["_single"])
    return rows.select(
        *terms.columns, F.coalesce("stage", F.when(F.col("_plural").isNotNull(), F.lit("plural"))).alias("stage"),
        F.coalesce("features", "_plural").alias("features"),
    )


def _marks(text: Column) -> Column:
    """(low, high, spare): a set of 128 bits with one for every letter and its number among equal ones, and how many of them share a bit."""
    letters = F.array_sort(F.split(text, ""))
    numbered = let(letters, lambda held: F.transform(held, lambda c, i: F.pmod(F.xxhash64(c, i - F.array_position(held, c)), F.lit(128))))

    def half(first: int) -> Column:
        inside = F.filter(numbered, lambda bit: (bit >= first) & (bit < first + 64))
        one = F.lit(1).cast("long")
        return F.aggregate(inside, F.lit(0).cast("long"), lambda bits, bit: bits.bitwiseOR(F.call_function("shiftleft", one, (bit - first).cast("int"))))

    return let(F.struct(half(0).alias("low"), half(64).alias("high")), lambda m: F.struct(
        m["low"].alias("low"), m["high"].alias("high"), (F.size(letters) - F.bit_count(m["low"]) - F.bit_count(m["high"])).alias("spare")))


def _most_alike(native: bool) -> Callable[[Column], Column]:
    """For a candidate the largest similarity that the letters in common allow.

    Letters that two texts share share their bits; those of a text that have no bit of their own are at most `spare`. So the
    letters in common are at most the common bits and the smaller `spare`. An edit distance is at least the longer length less them, and
    matching blocks hold no more than them.
    """
    size = F.length("_open")

    def bound(c: Column) -> Column:
        bits = F.bit_count(F.col("_marks.low").bitwiseAND(c["marks"]["low"])) + F.bit_count(F.col("_marks.high").bitwiseAND(c["marks"]["high"]))
        common = F.least(bits + F.least(F.col("_marks.spare"), c["marks"]["spare"]), size, F.length(c["name"]))
        return common / F.greatest(size, F.length(c["name"])) if native else 2 * common / (size + F.length(c["name"]))

    return bound


def _by_length(vocabulary: DataFrame) -> DataFrame:
    """Names of one length with their marks, in parts of bounded size."""
    return (
        vocabulary.select("feature").distinct()
        .groupBy(F.length("feature").alias("size"), F.pmod(F.xxhash64("feature"), F.lit(PARTS)).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("feature").alias("name"), _marks(F.col("feature")).alias("marks")))).alias("candidates"))
        .drop("part")
    )


def _alike(name: Column) -> Column:
    return F.lit(1.0) - F.levenshtein("_open", name) / F.greatest(F.length("_open"), F.length(name))


def _candidates(rows: DataFrame, key: list[str], vocabulary: DataFrame, cutoff: float, native: bool,
                first_pass: bool = True) -> DataFrame:
    """Each row of `_open` with the lists of names that can still be its best one; a row without any keeps a row.

    A cutoff bounds the lengths that can reach it: for 1 - distance / longer length the shorter is at least `cutoff` of the longer; for
    2m / (a + b) it is cutoff / (2 - cutoff). So texts meet names by length. Of these names those remain whose letters in common allow the
    cutoff; for the edit distance also the best similarity among the most promising names of all lists, which a `first_pass` over the rows scores. That pays
    for large vocabularies, and computes the rows twice.
    """
    share = cutoff if native else cutoff / (2 - cutoff)
    size, bound = F.length("_open"), _most_alike(native)
    shortest = F.greatest(F.ceil(size * F.lit(share) - F.lit(1e-9)).cast("int"), F.lit(1))
    longest = F.greatest(F.floor(size / F.lit(share) + F.lit(1e-9)).cast("int"), F.lit(1))
    lists = _by_length(vocabulary)

    def met(texts: DataFrame, keep: list[str]) -> DataFrame:
        marked = texts.withColumn("_marks", F.when(size > 0, _marks(F.col("_open"))))
        sized = marked.select(*keep, "_open", "_marks", F.explode_outer(F.when(size > 0, F.sequence(shortest, longest))).alias("size"))
        return lookup_join(sized, lists, ["size"], "left", spread=["_open"])

    pairs, least = met(rows, key), F.lit(cutoff)
    if native and first_pass:
        hopeful = F.array_max(F.transform("candidates", lambda c: F.struct(bound(c).alias("bound"), c["name"].alias("name"))))
        scored = met(rows.select("_open").filter(F.col("_open").isNotNull()), []).select("_open", hopeful.alias("_hope"))
        floor = scored.filter(F.col("_hope.bound") >= cutoff - 1e-9).groupBy("_open").agg(F.max(_alike(F.col("_hope.name"))).alias("_least"))
        pairs = pairs.join(floor, "_open", "left")
        least = F.greatest(F.coalesce("_least", F.lit(0.0)), F.lit(cutoff))
    near = F.filter("candidates", lambda c: bound(c) >= least - 1e-9)
    return pairs.select(*key, "_open", F.transform(near, lambda c: c["name"]).alias("candidates"), F.size("candidates").alias("_listed"))


def _levenshtein_best(cutoff: float) -> Column:
    """The best of `candidates` by 1 - distance / longer length, as (score, feature); null below the cutoff."""
    alike = F.array_max(F.transform("candidates", lambda name: F.struct(_alike(name).alias("score"), name.alias("feature"))))
    return F.when(alike["score"] >= cutoff, alike)


def _ratio_best(cutoff: float) -> Column:
    found = best_ratio(cutoff)(F.coalesce("_open", F.lit("")), F.coalesce("candidates", F.array().cast("array<string>")))
    return F.when(found["feature"].isNotNull(), F.struct(found["score"].alias("score"), found["feature"].alias("feature")))


def _closest(rows: DataFrame, key: list[str], vocabulary: DataFrame, cutoff: float, native: bool,
             first_pass: bool = True) -> DataFrame:
    """(key…, _close, _score): the best name of the vocabulary for the text in `_open`, null where it is null or nothing is close."""
    pairs = _candidates(rows, key, vocabulary, cutoff, native, first_pass)
    best = (_levenshtein_best if native else _ratio_best)(cutoff)
    top = pairs.select(*key, best.alias("_best")).groupBy(*key).agg(F.max("_best").alias("_top"))
    return top.select(*key, F.col("_top.feature").alias("_close"), F.col("_top.score").alias("_score"))


def _fuzzy(terms: DataFrame, vocabulary: DataFrame, cutoff: float, native: bool) -> DataFrame:
    found = _closest(terms.select("norm", F.col("norm").alias("_open")), ["norm"], vocabulary, cutoff, native)
    return found.filter(F.col("_close").isNotNull()).select("norm", F.col("_close").alias("feature"), F.col("_score").alias("score"))


def fuzzy_ratio(terms: DataFrame, vocabulary: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Best feature per distinct `norm` by matching-block ratio; (norm, feature, score)."""
    return _fuzzy(terms, vocabulary, cutoff, False)


def fuzzy_levenshtein(terms: DataFrame, vocabulary: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """J3 without Python: similarity 1 - distance / longer length; ties to the larger name."""
    return _fuzzy(terms, vocabulary, cutoff, True).withColumn("score", F.round("score", 4))


def known_phrases(features: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Feature names and synonym phrases with blanks, without repeats."""
    names = features.select(F.col("feature").alias("phrase")).unionByName(synonyms.select("phrase"))
    return names.select(F.replace("phrase", F.lit("_"), F.lit(" ")).alias("phrase")).distinct()


def extract_phrases(terms: DataFrame, phrases: DataFrame, column: str = "raw", key: str | None = None) -> DataFrame:
    """Adds `found`, the phrases pulled out of run-on text, longest first.

    Each step takes the longest phrase still contained (equal lengths: alphabetical), puts a
    blank in its place, collapses blanks, and starts over. Taking a phrase out leaves a blank and so makes no new word: only
    phrases whose words are all part of the text are tried, which one pass with an automaton of the words finds.
    """
    text = F.lower(strip(column))
    listed = possible(terms, phrases, text, "phrase", "_phrases", key or column)
    return listed.withColumn("found", _pull(text, F.col("_phrases"))).drop("_phrases")


def _pull(start: Column, ordered: Column) -> Column:
    state = F.struct(start.alias("rest"), F.array().cast("array<string>").alias("found"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        hits = F.slice(F.filter(ordered, lambda p: F.contains(acc["rest"], p)), 1, 1)
        taken = F.transform(hits, lambda hit: F.struct(
            strip(F.regexp_replace(_first_as_blank(acc["rest"], hit), r"(?U)\s+", " ")).alias("rest"),
            F.concat(acc["found"], F.array(hit)).alias("found"),
            F.lit(False).alias("done"),
        ))
        stop = F.struct(acc["rest"].alias("rest"), acc["found"].alias("found"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).otherwise(F.coalesce(F.get(taken, F.lit(0)), stop))

    # Each step takes out at least one character or ends the search.
    steps = F.sequence(F.lit(1), F.greatest(F.length(start), F.lit(1)))
    return F.when(F.size(ordered) == 0, state["found"]).otherwise(F.aggregate(steps, state, step, lambda acc: acc["found"]))


def _first_as_blank(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.concat(F.substr(text, F.lit(1), at - 1), F.lit(" "), F.substr(text, at + F.length(part)))


def resolve_terms(terms: DataFrame, features: DataFrame, synonyms: DataFrame,
                  cutoff: float = FUZZY_CUTOFF, native: bool = False) -> DataFrame:
    """J2 → J3 → J4 for distinct raw terms: (raw, stage, features).

    Stages in order: exact, synonym, plural, fuzzy, extracted, unmatched; the first hit stops.
    Phrases pulled out of run-on text go through the first four stages again.
    """
    meanings = dictionary(features, synonyms)
    keyed = terms.select("raw").distinct().withColumn("norm", normalise_term("raw")).filter(F.col("norm") != "")
    staged = _stage(keyed, meanings)
    open_norm = F.when(F.col("stage").isNull(), F.col("norm"))
    close = _closest(staged.withColumn("_open", open_norm), ["raw", "norm", "stage", "features"], features, cutoff, native, first_pass=False)
    direct = close.select(
        "raw", F.coalesce("stage", F.when(F.col("_close").isNotNull(), F.lit("fuzzy"))).alias("stage"),
        F.coalesce("features", F.when(F.col("_close").isNotNull(), F.array("_close"))).alias("features"),
        F.when(F.col("stage").isNull() & F.col("_close").isNull(), F.col("raw")).alias("_text"),
    )
    pulled = extract_phrases(direct, known_phrases(features, synonyms), "_text", "raw")
    # A known phrase is a feature or a listed synonym by construction. Outer: every term keeps a row.
    found = pulled.select("raw", "stage", "features", F.explode_outer("found").alias("_phrase")).withColumn("norm", normalise_term("_phrase"))
    none = F.array().cast("array<string>")
    parts = lookup_join(found, meanings.select("norm", F.col("features").alias("_features")), ["norm"], spread=["raw"])
    joined = parts.groupBy("raw").agg(
        F.first("stage").alias("stage"), F.first("features").alias("features"), F.count("_phrase").alias("_n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_features")))).alias("_pulled"),
    )
    return joined.select(
        "raw", F.coalesce("stage", F.when(F.col("_n") > 0, F.lit("extracted")), F.lit("unmatched")).alias("stage"),
        F.coalesce("features", F.when(F.col("_n") > 0, F.col("_pulled")), none).alias("features"),
    )


def map_symptoms(requests: DataFrame, features: DataFrame, synonyms: DataFrame, key: str = "request_id",
                 cutoff: float = FUZZY_CUTOFF, native: bool = False, resolved: DataFrame | None = None) -> DataFrame:
    """(key, matched): sorted distinct features per request; requests without any get an empty list.

    `resolved` may bring the terms of the requests already resolved, as a `TermStore` does.
    """
    if resolved is None:
        resolved = resolve_terms(exploded_terms(requests, key), features, synonyms, cutoff, native)
    # Outer: a request without terms keeps a row, so no join back to the requests is needed.
    terms = requests.select(key, F.explode_outer("symptoms").alias("raw"))
    return by_key(lookup_join(terms, resolved.select("raw", "features"), ["raw"], "left", spread=[key]), key).groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("features")))).alias("matched")
    )


def unmatched_terms(terms: DataFrame, resolved: DataFrame) -> DataFrame:
    """Terms that matched nothing, with how often they were entered."""
    counts = terms.groupBy("raw").agg(F.count("*").alias("n"))
    hit = resolved.filter(F.col("stage") != "unmatched").select("raw")
    return counts.filter(strip("raw") != "").join(hit, "raw", "left_anti")


def feature_vector(rows: DataFrame, features: list[str], column: str = "symptoms") -> DataFrame:
    """adds `vector`, 1/0 per feature in the given order, from normalised terms."""
    present = F.transform(column, normalise_term)
    vector = let(present, lambda held: F.transform(F.lit(features), lambda name: F.array_contains(held, name).cast("int")))
    return rows.withColumn("vector", vector)
