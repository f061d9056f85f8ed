"""Quality rules: text statistics, and a likelihood ratio of hashed n-grams against the corpus.

The n-grams are those of words (each word by itself) and of characters (the last three of each word).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import BROADCAST_BYTES, packed, table

#: Word breaks: space and the controls 9 to 13.
BREAKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
BUCKETS = 8192
SMOOTHING = 1.0
LEAST_RATIO = -1.0
MIN_WORDS = 50


def with_base(rows: DataFrame) -> DataFrame:
    """Adds to packed rows the words of the text, their hashes and the base statistics, all in the row."""
    text = F.coalesce("_row.text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("_words", F.array_remove(F.split(text, BREAKS), "")).withColumn("_lines", lines).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_mask": F.expr("shiftleft(cast(-1 as bigint), length(bin(size(_words))))"),
    })
    # a hash of each window of three words
    rows = rows.withColumn("_windows", F.expr("""if(size(_words) < 3, cast(array() as array<bigint>),
        transform(slice(_hashes, 3, size(_hashes)), (h, i) -> xxhash64(get(_hashes, i), get(_hashes, i + 1), h)))"""))
    # The windows sorted with their places in the low bits: equal ones become neighbours.
    rows = rows.withColumn("_sorted", F.expr("""if(size(_windows) = size(array_distinct(_windows)),
        cast(array() as array<bigint>), sort_array(transform(_windows, (h, i) -> (h & _mask) | i)))"""))
    same = ("(((get(_sorted, k {0} 1) ^ p) & _mask) = 0 and "
            "get(_windows, cast(get(_sorted, k {0} 1) & ~_mask as int)) = get(_windows, cast(p & ~_mask as int)))")
    rows = rows.withColumn("_repeats", F.expr(f"""sort_array(filter(
        transform(_sorted, (p, k) -> if({same.format('-')} or {same.format('+')}, cast(p & ~_mask as int), -1)), x -> x >= 0))"""))
    rows = rows.withColumn("n_repeat_words", F.expr("""aggregate(
        transform(_repeats, (p, k) -> least(3, coalesce(get(_repeats, k + 1) - p, 3))), 0L, (a, x) -> a + x)"""))
    return rows.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ).drop("_lines", "_windows", "_mask", "_sorted", "_repeats")


def word_bucket(hashed: str, buckets: int) -> str:
    return f"cast(pmod({hashed}, {buckets}) as int)"


def tail_bucket(word: str, buckets: int) -> str:
    """Bucket of the n-gram of a word's last three characters; these have their own range of buckets."""
    return f"cast(pmod(xxhash64(right({word}, 3)), {buckets}) as int) + {buckets}"


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with `ratio`: by bucket, ln(share among the n-grams of trusted rows / share among those of all rows).

    Both multinomials are counted over whole texts of all rows, smoothed by `SMOOTHING` per bucket.
    `trusted` has distinct doc_ids; they are broadcast below a checked size.
    """
    small = trusted.count() * 16 <= BROADCAST_BYTES
    marked = trusted.select("doc_id", F.lit(1).alias("_trusted"))
    rows = docs.select("doc_id", F.array_remove(F.split(F.coalesce("text", F.lit("")), BREAKS), "").alias("_words"))
    counts = (
        rows.join(F.broadcast(marked) if small else marked, "doc_id", "left")
        .select(F.explode("_words").alias("w"), F.coalesce("_trusted", F.lit(0)).alias("_trusted"))
        .select(F.explode(F.array(F.expr(word_bucket("xxhash64(w)", buckets)), F.expr(tail_bucket("w", buckets)))).alias("bucket"),
                "_trusted")
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_trusted").alias("target"))
    )
    every = docs.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(counts, "bucket", "left").na.fill(0).select(
        "bucket", (F.col("bucket") >= buckets).alias("kind"), "raw", "target")
    sums = dense.groupBy("kind").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    share = lambda n, of: F.ln((F.col(n) + SMOOTHING) / (F.col(of) + SMOOTHING * buckets))
    logs = dense.join(F.broadcast(sums), "kind").select(
        "bucket", F.when(F.col("all_target") > 0, share("target", "all_target") - share("raw", "all_raw")).otherwise(0).cast("float").alias("r"))
    return logs.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "r"))), lambda x: x.r).alias("ratio"))


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, least: float = LEAST_RATIO) -> DataFrame:
    """The whole rows of `docs` as `_row`, with the base statistics, `ratio` (mean log ratio of the text's n-grams)
    and `kept`.

    Trusted are the documents labelled with quality 1. The mean of ln(p_trusted / p_corpus) over all
    n-grams of a text is compared with `least`; every document is judged alike. Without
    trusted documents all ratios are 0, and the base rules alone decide.

    A null text counts as empty: no words, ratio 0, base_failed. Long texts are read whole, in the
    row. Equal rows get equal verdicts. An empty table gives no rows. Other columns stay in `_row`.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    found = with_base(packed(docs)).withColumn("_ratios", ratios(docs, trusted, buckets).scalar())
    each = f"get(_ratios, {word_bucket('get(_hashes, i)', buckets)}) + get(_ratios, {tail_bucket('w', buckets)})"
    found = found.withColumn("ratio", F.expr(f"""coalesce(aggregate(transform(_words, (w, i) -> {each}), 0d,
        (a, x) -> a + x) / nullif(2 * size(_words), 0), 0d)"""))
    # The random number from 0 to below 1 decides nothing. It keeps the optimizer from pushing filters on `kept`
    # below the steps that compute it, where it would write these out many times over.
    verdict = ~F.col("base_failed") & (F.col("ratio") >= least)
    return found.withColumn("kept", verdict.cast("int") + F.rand() >= 1).drop("_words", "_hashes", "_ratios")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "ratio")
