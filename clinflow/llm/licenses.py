"""Licence statements in texts: ordered signature rules behind a keyword filter."""

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm import license_rules
from clinflow.llm.common import bound_batches, packed, table
from clinflow.llm.license_rules import rules
from clinflow.session import send_by_value

send_by_value(__name__)
send_by_value(license_rules.__name__)

#: What separates words: the ASCII signs that are neither digits nor letters. All other characters are part of words.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
FOLD = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))
#: Phrases that are always reported, their labels, and the rarest word of each.
PHRASES = ((b"cc by", "cc-by", b"cc"), (b"general public license", "gpl", b"general"), (b"all rights reserved", "reserved", b"reserved"))
PHRASE_WORTH = 0.5
NEW = ("n_words", "places", "finds")

FOUND = ("struct<n_words:bigint,places:array<struct<label:string,first_word:bigint>>,"
         "finds:array<struct<label:string,worth:double,first_word:bigint,last_word:bigint>>>")

_rules: list = []


def prepared() -> tuple[list, dict[bytes, list[int]], list[re.Pattern]]:
    """Rules, their numbers by keyword, and the patterns of the phrases: made once in a process."""
    if not _rules:
        every = rules()
        by_word: dict[bytes, list[int]] = {}
        for i, rule in enumerate(every):
            for word in rule.keywords:
                by_word.setdefault(word, []).append(i)
        _rules.extend([every, by_word, [re.compile(rb"(?<![^ ])(?=" + phrase + rb"(?![^ ]))") for phrase, _, _ in PHRASES]])
    return tuple(_rules)


def outermost(finds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of finds (rule, start, end) those that lie in no find of an earlier rule, nor in an earlier or longer one of their own.

    The intervals that lie in no other one are held by start, so that their ends rise as well.
    """
    starts, ends, kept = [], [], []
    for rule, start, end in sorted(finds, key=lambda f: (f[0], f[1], -f[2])):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((rule, start, end))
        if at and starts[at - 1] == start:
            at -= 1
        last = bisect_right(ends, end, at)
        starts[at:last], ends[at:last] = [start], [end]
    return kept


def scanned(text: str) -> tuple[int, list, list]:
    """The number of words, the places of phrases, and the finds of rules, in words from 0."""
    words = text.encode("utf-8", "replace").translate(FOLD).split()
    every, by_word, phrases = prepared()
    held = set(words)
    gated = sorted({i for word in by_word.keys() & held for i in by_word[word]})
    if not gated and not any(word in held for _, _, word in PHRASES):
        return len(words), [], []
    line = b" ".join(words)
    places = [(label, m.start()) for (_, label, word), pattern in zip(PHRASES, phrases) if word in held for m in pattern.finditer(line)]
    finds = outermost([(i, *m.span()) for i in gated for m in every[i].pattern.finditer(line)])
    number, at, count = {}, 0, 0
    for position in sorted({p for _, p in places} | {p for _, start, end in finds for p in (start, end)}):
        count += line.count(b" ", at, position)
        at = position
        number[position] = count
    return (len(words), sorted(((label, number[p]) for label, p in places), key=lambda x: x[::-1]),
            [(every[i].label, every[i].worth, number[start], number[end]) for i, start, end in sorted(finds, key=lambda f: (f[1], f[2]))])


def found_in(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scanned(text) for text in texts], columns=list(NEW))


def licences(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with `n_words`, `places` of the fixed phrases (label, first_word) and `finds` of the rules.

    A find has the label, its worth (0 to 1) and its first and last word. A rule is tried only on texts that hold one of its keywords. A find
    that lies within one of an earlier rule isn't reported: the special licence hides the general name in it.

    Null and empty texts have no words and no finds. Texts are read whole, one at a time; equal rows are judged one by one; an empty
    table gives no rows. Other columns stay; those named like the new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    found = packed(docs, F.pandas_udf(found_in, FOUND)(F.coalesce("text", F.lit(""))).alias("_found"))
    return found.select(*[F.col(f"_row.`{name}`") for name in docs.columns if name not in NEW], "_found.*")


def names(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and the worth of the best find of every document; a fixed phrase is worth 0.5."""
    found = licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.col("places.label")
    words = F.col("places.first_word")
    worth = F.greatest(F.coalesce(F.array_max("finds.worth"), F.lit(0.0)), F.when(F.size("places") > 0, PHRASE_WORTH).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, F.col("finds.label"))).alias("labels"), worth.alias("score"),
    )
