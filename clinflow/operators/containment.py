"""Joins on "the text contains the name".

The names are cut into blocks of bounded bytes. Each task builds a dictionary automaton of one block and reads every text once, whatever
the number of names; texts are searched where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.session import send_by_value, written

send_by_value(__name__)

#: Bytes of names that one automaton holds (its nodes take some fifty times as much).
BLOCK_BYTES = 8 * 1024 * 1024


def blocks(names: DataFrame, columns: list[str], size: int | None = None) -> Iterator[list[tuple]]:
    """The distinct rows of `names` in blocks of about `size` bytes by hash, one after another.

    The bytes are counted first. Only one block at a time is on the driver, on its way to the executors.
    """
    wanted = names.select(*columns).distinct()
    bytes_of = sum((F.octet_length(F.col(name).cast("string")) for name in columns), F.lit(8))
    total = wanted.agg(F.sum(bytes_of)).first()[0] or 0
    parts = -(-total // (size or BLOCK_BYTES))
    for part in range(parts):
        held = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64(*columns), F.lit(parts)) == part)
        rows = [tuple(row) for row in held.toLocalIterator()]
        if rows:
            yield rows


def automaton(words: dict) -> ahocorasick.Automaton:
    """Finds every one of the words; a find gives the value of its word."""
    found = ahocorasick.Automaton()
    for word, value in words.items():
        found.add_word(word, value)
    found.make_automaton()
    return found


def per_task(spark: SparkSession, rows: list[tuple], build: Callable, answer: Callable, kind: str) -> Callable:
    """A batched function from texts to `answer(built, text)`; `build(rows)` runs once in each task, null texts give null."""
    sent = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = build(sent.value)
        for texts in batches:
            yield pd.Series([None if text is None else answer(built, text) for text in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def all_names(rows: list[tuple]) -> ahocorasick.Automaton:
    return automaton({name: name for (name,) in rows})


def held_names(built: ahocorasick.Automaton, text: str) -> list[str]:
    return sorted({name for _, name in built.iter(text)})


def contained_pairs(texts: DataFrame, names: DataFrame, text: str, name: str, key: list[str], block_bytes: int | None = None) -> DataFrame:
    """(key…, name) for every distinct name that is part of the text; both sides as given, case and all.

    Empty and null names are part of no text; null texts hold none. Rows of equal keys stay apart.
    """
    spark = texts.sparkSession
    out = texts.limit(0).select(*key, F.lit(None).cast("string").alias(name))
    for rows in blocks(names.filter(F.col(name) != ""), [name], block_bytes):
        found = per_task(spark, rows, all_names, held_names, "array<string>")
        # Outer: Spark would look into the array of an inner one a second time, to drop the empty ones first.
        out = out.unionByName(texts.select(*key, F.explode_outer(found(F.col(text))).alias(name)).filter(F.col(name).isNotNull()))
    return out


def best_names(rows: list[tuple]) -> ahocorasick.Automaton:
    """Lower-case names to their rank and form: the longest first, then alphabetical."""
    best: dict[str, tuple[int, str]] = {}
    for low, size, name in rows:
        entry = (-size, name)
        best[low] = min(best.get(low, entry), entry)
    return automaton(best)


def best_name(built: ahocorasick.Automaton, text: str) -> str | None:
    return min((entry for _, entry in built.iter(text)), default=(0, None))[1]


def longest_name(texts: DataFrame, names: DataFrame, text: str, name: str, out: str, block_bytes: int | None = None) -> DataFrame:
    """Adds `out`, the longest name contained in the text in any case, or null.

    Equally long names: the alphabetically first. Empty and null names are never found. With names of several blocks the
    rows are numbered and written once, and the best finds of the blocks meet by that number.
    """
    spark = texts.sparkSession
    forms = names.filter(F.col(name) != "").select(F.lower(name).alias("low"), F.length(name).alias("size"), F.col(name).alias("name"))
    searches: list[Callable[[], Column]] = []
    for rows in blocks(forms, ["low", "size", "name"], block_bytes):
        searches.append(per_task(spark, rows, best_names, best_name, "string"))
    if not searches:
        return texts.withColumn(out, F.lit(None).cast("string"))
    low = F.lower(F.col(text))
    if len(searches) == 1:
        return texts.withColumn(out, searches[0](low))
    numbered = written(texts.withColumn("_number", F.monotonically_increasing_id()), "contained")
    finds = None
    for search in searches:
        some = numbered.select("_number", search(low).alias("_name")).filter(F.col("_name").isNotNull())
        finds = some if finds is None else finds.unionByName(some)
    best = finds.groupBy("_number").agg(F.min(F.struct(-F.length("_name"), "_name")).alias("_best"))
    return numbered.join(best, "_number", "left").withColumn(out, F.col("_best._name")).drop("_number", "_best")


def by_rare_word(rows: list[tuple]) -> tuple[ahocorasick.Automaton, dict[str, list[tuple[str, ...]]]]:
    """All words of the phrases, and the phrases by their longest word."""
    words, phrases = {}, {}
    for (phrase,) in rows:
        parts = tuple(part for part in phrase.split(" ") if part)
        words.update((part, part) for part in parts)
        if parts:
            phrases.setdefault(max(parts, key=len), []).append((phrase, *parts))
    return automaton(words), phrases


def possible_phrases(built: tuple, text: str) -> list[str]:
    """Phrases all of whose words are part of the text."""
    found, phrases = built
    held = {word for _, word in found.iter(text)}
    return [phrase for word in held for phrase, *parts in phrases.get(word, ()) if held.issuperset(parts)]


def possible(texts: DataFrame, phrases: DataFrame, text: Column, phrase: str, out: str, key: str, block_bytes: int | None = None) -> DataFrame:
    """Adds `out`, the phrases all of whose words (cut at blanks) are part of the text: longest first, then alphabetical.

    `key` names the rows, each once; with phrases of several blocks the finds meet by it.
    """
    spark = texts.sparkSession
    searches = [per_task(spark, rows, by_rare_word, possible_phrases, "array<string>")
                for rows in blocks(phrases.filter(F.trim(phrase) != ""), [phrase], block_bytes)]
    none = F.array().cast("array<string>")
    if not searches:
        return texts.withColumn(out, none)
    if len(searches) == 1:
        return texts.withColumn(out, longest_first(F.coalesce(searches[0](text), none)))
    parts = None
    for search in searches:
        some = texts.select(key, F.explode_outer(search(text)).alias("_one")).filter(F.col("_one").isNotNull())
        parts = some if parts is None else parts.unionByName(some)
    lists = parts.groupBy(key).agg(F.collect_set("_one").alias(out))
    return texts.join(lists, key, "left").withColumn(out, longest_first(F.coalesce(out, none)))


def longest_first(phrases: Column) -> Column:
    ranked = F.array_sort(F.transform(phrases, lambda p: F.struct((-F.length(p)).alias("size"), p.alias("phrase"))))
    return F.transform(ranked, lambda p: p["phrase"])
