"""Fuzzy duplicates of lines by MinHash of their character shingles."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import bound_batches, keep_matching, partitions_of, table
from clinflow.llm.hashing import band_keys, blocks, char_shingles, mix
from clinflow.llm.similar import linked
from clinflow.session import send_by_value, written

send_by_value(__name__)

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
#: Band keys have 40 bits: two different bands that share one by chance are told apart by sketches.
KEY = 2**40 - 1
#: Bits of a sketch for the elements, those that must be the same at a Jaccard of 0.8, the step of sizes, and the size where the kind of sketch changes.
BITS, SAME, STEP, SHORT = 56, 38, 1.05, 128
#: Texts of one key whose sketches are compared pair by pair.
RUN = 2048
#: Bits of a node that hold the number of the line in its document.
LINE = 2**31


def min_hash(owner: np.ndarray, hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    """MinHash signatures (n by `size`) by one permutation: the least hash in each of `size` bins.

    An empty bin takes the value of another bin, which it looks for in an order of its own that is the same in
    all signatures (optimal densification), so bins agree with the probability of the Jaccard.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full(n * size, none)
    np.minimum.at(signature, owner * size + (hashes % np.uint64(size)).astype(np.int64), hashes)
    dense = signature.copy()
    filled = np.zeros(n, bool)
    filled[owner] = True
    empty = np.flatnonzero((signature == none) & np.repeat(filled, size))
    turn = 0
    while len(empty):
        turn += 1
        row, column = np.divmod(empty, size)
        other = (mix(np.arange(size, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(turn)) % np.uint64(size)).astype(np.int64)[column]
        value = signature[row * size + other]
        found = value != none
        dense[empty[found]] = mix(value[found] ^ column[found].astype(np.uint64))
        empty = empty[~found]
    return dense.reshape(n, size)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text): the lines that hold more than white space, numbered from 0 among all lines."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text")
    return docs.where("doc_id is not null").select("doc_id", split).where(F.col("text").rlike(r"\S"))


def node(doc_id: str = "doc_id", line: str = "line"):
    """A number for a line that ascends with the document and then the line."""
    return (F.col(doc_id).cast("decimal(19,0)") * F.lit(LINE).cast("decimal(10,0)") + F.col(line)).cast("decimal(31,0)")


def hashed_lines(docs: DataFrame) -> DataFrame:
    """`lines_of` with a hash of 128 bits of the line's text in two columns."""
    return lines_of(docs).withColumn("first", F.xxhash64("text")).withColumn("second", F.xxhash64(F.lit("again"), "text"))


def text_key(first: str = "first", second: str = "second"):
    """The hash of a text as one value, 16 bytes."""
    return F.unhex(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def sketches(owner: np.ndarray, hashes: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """64 bits for each set of shingles, from which `may_be_near` tells most pairs apart: 8 of its size, 56 of its elements.

    The size is given in steps of 5 %. A set of fewer than `SHORT` elements has the parities of the elements that fall on
    each bit, a larger one a bit of each of 56 values of its signature.
    """
    n = len(signatures)
    low = np.uint64(max(n.bit_length(), 1))
    assert low <= 24
    found = np.sort((owner.astype(np.uint64) << (np.uint64(64) - low)) | (hashes >> low))
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    found = found[new]
    owner, hashes = (found >> (np.uint64(64) - low)).astype(np.int64), found << low
    size = np.bincount(owner, minlength=n)
    step = np.minimum(np.floor(np.log(np.maximum(size, 1)) / np.log(STEP) + 1e-9), 255).astype(np.uint64)
    bits = ((signatures[:, :BITS] >> np.uint64(20)) & np.uint64(1)) << np.arange(BITS, dtype=np.uint64)
    sketch = np.bitwise_or.reduce(bits, axis=1)
    few = size < SHORT
    sketch[few] = 0
    owner, hashes = owner[few[owner]], hashes[few[owner]]
    np.bitwise_xor.at(sketch, owner, np.uint64(1) << ((hashes >> np.uint64(32)) % np.uint64(BITS)))
    return (sketch << np.uint64(8)) | step


def may_be_near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets with the sketches a and b may have a Jaccard of `least`.

    Sizes must allow it. Two small sets differ in at least as many elements as parities, which excludes them for certain.
    Of two large ones at a Jaccard of 0.8, 50 of 56 bits are the same on average; fewer than 38 exclude the pair, with a chance of about one
    in a million. Pairs of a small and a large set are only told by their sizes. Below 0.8 the share of bits is lowered in proportion.
    """
    steps = [(x & np.uint64(255)).astype(np.int64) for x in (a, b)]
    alike = np.abs(steps[0] - steps[1]) <= np.ceil(np.log(1 / least) / np.log(STEP)) + 1e-9
    differ = np.bitwise_count((a ^ b) >> np.uint64(8)).astype(np.int64)
    most = [np.floor(STEP ** (x + 1.0) + 1e-6) for x in steps]
    few = [x < np.floor(np.log(SHORT) / np.log(STEP)) for x in steps]
    many = [x > np.floor(np.log(SHORT) / np.log(STEP)) for x in steps]
    excluded = np.where(few[0] & few[1], differ > (most[0] + most[1]) * (1 - least) / (1 + least) + 1e-6,
                        many[0] & many[1] & (differ > (BITS - SAME) * (1 - least) / 0.2))
    return alike & ~excluded


def line_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, sketch, bands) of the lines; once for the equal lines of a batch. Band keys have 40 bits."""
    for batch in batches:
        _, once = np.unique(np.stack([batch["first"].to_numpy(), batch["second"].to_numpy()]), axis=1, return_index=True)
        batch = batch.take(pa.array(np.sort(once)))
        texts, found, seen = batch["text"].to_pylist(), [np.zeros((0, BANDS), np.int64)], [np.zeros(0, np.uint64)]
        for start, stop in blocks(texts):
            owner, hashes = char_shingles(texts[start:stop], WIDTH)
            signatures = min_hash(owner, hashes, stop - start, BANDS * ROWS)
            found.append(band_keys(signatures, BANDS, ROWS) & KEY)
            seen.append(sketches(owner, hashes, signatures))
        keys = pa.array(np.concatenate(found).ravel())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), keys)
        yield pa.RecordBatch.from_arrays([batch["first"], pa.array(np.concatenate(seen).view(np.int64)), bands], ["first", "sketch", "bands"])


def near_in_run(key: np.ndarray, first: np.ndarray, sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, first) of the rows that may be near to another row of their key; rows are in order of key and `first`.

    Rows of a key that no chain of such pairs connects get different keys.
    """
    size, sketch = len(key), sketch.view(np.uint64)
    new = np.ones(size, bool)
    new[1:] = key[1:] != key[:-1]
    run = np.cumsum(new) - 1
    stop = np.append(np.flatnonzero(new)[1:], size)[run] if size else np.zeros(0, np.int64)
    here, left, right, step = np.arange(size), [], [], 0
    while len(here):
        step += 1
        here = here[here + step < stop[here]]
        near = here[may_be_near(sketch[here], sketch[here + step], least)]
        left.append(near)
        right.append(near + step)
    left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    label = np.arange(size)
    while True:
        lower = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, lower)
        np.minimum.at(label, right, lower)
        label = label[label]
        if np.array_equal(label, before):
            break
    stay = np.unique(np.concatenate([left, right]))
    return mix(key[stay].view(np.uint64) ^ mix(first[label[stay]].view(np.uint64))).view(np.int64), first[stay]


def near_rows(least: float):
    """A function from the sorted (first, sketch, key) of a partition to the (key, first) that have a possible partner.

    It holds the rows of one key, at most `RUN` different texts; a key with more gives all of its rows as they come.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(3)]
        full = None  # the key that has more than RUN texts

        def found(key, first):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(first)], ["key", "first"])

        for batch in batches:
            rows = [np.concatenate([x, batch[name].to_numpy()]) for x, name in zip(held, ("key", "first", "sketch"))]
            if full is not None:
                mine = rows[0] == full
                yield found(rows[0][mine], rows[1][mine])
                rows = [x[~mine] for x in rows]
            edge = rows[0][1:] != rows[0][:-1]
            several = ~(np.append(True, edge) & np.append(edge, False))[: len(rows[0])]  # the last key may go on
            rows = [x[several] for x in rows]
            order = np.lexsort((rows[1], rows[0]))
            rows = [x[order] for x in rows]
            key, first = rows[:2]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1])
            rows = [x[once] for x in rows]
            if not len(rows[0]):
                held = rows
                continue
            start = np.append(0, np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1)
            count = np.diff(np.append(start, len(rows[0])))
            large = np.repeat(count > RUN, count)
            last = (np.arange(len(rows[0])) >= start[-1]) & ~large
            if large.any():
                yield found(rows[0][large], rows[1][large])
                if large[-1]:
                    full = rows[0][-1]
            ready = ~large & ~last
            yield found(*near_in_run(*[x[ready] for x in rows], least))
            held = [x[last] for x in rows]
        yield found(*near_in_run(*held, least))

    return near


def buckets(docs: DataFrame, hashed: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, node, n), the `n` texts of a band key that may be near to another of them, and (node, text) of these texts.

    Signatures are made where the lines are, so no text moves for them. Each line sends twenty rows of a key, a hash and a sketch; they
    are sorted by key, and of each key only the texts go on whose sketches allow a pair. Texts that share a key by chance, whose
    number grows with the square of the lines, end there. One row of each text that goes on gives the text.
    """
    signed = hashed_lines(docs).select("first", "second", "text").mapInArrow(line_bands, "first long, sketch long, bands array<long>")
    rows = signed.select("first", "sketch", F.explode("bands").alias("key"))
    rows = rows.repartition(partitions_of(docs.sparkSession), "key").sortWithinPartitions("key")
    near = written(rows.mapInArrow(near_rows(least), "key long, first long"), "line-near")
    needed = written(near.select("first").distinct(), "line-needed")
    homes = keep_matching(hashed, needed, ["first"]).groupBy("first", "second").agg(F.min(F.struct("doc_id", "line")).alias("home"))
    homes = written(homes.select("first", text_key().alias("node"), "home.*"), "line-homes")
    known = near.join(homes.select("first", "node"), "first").select("key", "node").distinct()
    sizes = known.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(known.join(sizes, "key"), "line-members")
    docs_near = keep_matching(docs.select("doc_id", "text"), homes.select("doc_id").distinct(), ["doc_id"])
    texts = lines_of(docs_near).join(homes, ["doc_id", "line"]).where(
        text_key(F.xxhash64("text"), F.xxhash64(F.lit("again"), "text")) == F.col("node"))
    return members, written(texts.select("node", "text"), "line-texts")


def line_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, line, class_id): the class of every line that holds more than white space.

    Lines are sets of runs of five characters; two are near duplicates from a Jaccard of `least` on.
    A class is a connected component, and its id is the `node` number of its first line. Equal lines are one
    item from the beginning. Candidates share one of 20 bands of 5 values each, which misses a pair at 0.8
    with a chance of 4 in 10,000, and every candidate is checked exactly. A line of fewer than five characters
    is one shingle, so it is near only to an equal line. A line is signed and compared whole, however long it is.

    Null and empty texts have no lines. Rows without doc_id are not in the result; rows that repeat a
    doc_id share its line numbers, so classes that begin with the same number have the same id. An empty table gives no rows.
    Other columns are not read.
    """
    return shared_classes(docs, least).withColumn("class_id", F.coalesce("class_id", node()))


def shared_classes(docs: DataFrame, least: float) -> DataFrame:
    """`line_classes` with a null class for lines that are a class of their own."""
    bound_batches(docs.sparkSession)
    hashed = written(hashed_lines(docs).drop("text"), "line-hashes")
    members, texts = buckets(docs, hashed, least)
    roots = linked(members, lambda needed: keep_matching(texts, needed, ["node"], 48), char_shingles, WIDTH, least, False, "lines")

    different = hashed.groupBy("first", "second").agg(F.min(node()).alias("own"), F.count("*").alias("n"))
    different = written(different.join(roots.withColumnRenamed("node", "_key"), text_key() == F.col("_key"), "left").drop("_key"), "line-different")
    near = different.where("root is not null")
    heads = near.groupBy("root").agg(F.min("own").alias("class_id"))
    columns = ["first", "second", "n", "class_id", "own"]
    # Texts that are near to no other have no root and stay out of the join, where they would meet in one task.
    alone = different.where("root is null").withColumn("class_id", F.col("own")).select(*columns)
    classed = near.join(heads, "root").select(*columns).unionByName(alone)
    # A text that stands once and has no earlier one is its own class; only the others are looked up.
    classed = written(classed.where("n > 1 or class_id != own").drop("own"), "line-classes")
    # Texts with more rows than a task's share are few (as many as there are shares), so they are broadcast and their rows stay where they are.
    share = max(hashed.count() // (4 * partitions_of(docs.sparkSession)), 1)
    hot = F.broadcast(classed.where(F.col("n") > share).drop("n"))
    rest = classed.where(F.col("n") <= share).drop("n")
    keys = ["first", "second"]
    usual = hashed.join(hot.select(*keys), keys, "left_anti").join(rest, keys, "left")
    return hashed.join(hot, keys).unionByName(usual).select("doc_id", "line", "class_id")


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped): by document, the lines of earlier classes.

    `dropped` lists, by line, the lines that go because the class has an earlier line: the line's number, and the
    document and line that stay. Documents without lines have none. Rows that repeat a doc_id are counted together.
    """
    found = shared_classes(docs, least)
    goes = F.when(F.col("class_id").isNotNull() & (F.col("class_id") != node()), F.struct(
        "line", F.floor(F.col("class_id") / LINE).cast("long").alias("kept_doc"), (F.col("class_id") % LINE).cast("int").alias("kept_line")))
    counts = found.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count(goes).alias("n_dropped"), F.array_sort(F.collect_list(goes)).alias("dropped"))
    none = F.expr("cast(array() as array<struct<line: int, kept_doc: bigint, kept_line: int>>)")
    return docs.where("doc_id is not null").select("doc_id").distinct().join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.coalesce("dropped", none).alias("dropped"))


def without_repeats(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """`docs` with texts that lack the dropped lines; for tables whose doc_ids are unique."""
    drops = deduplicated(docs, least).select("doc_id", F.col("dropped.line").alias("_gone"))
    kept = "array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(_gone, i)), '\\n')"
    text = F.when(F.size("_gone") > 0, F.expr(kept)).otherwise(F.col("text"))
    return docs.join(drops, "doc_id", "left").withColumn("text", text).select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
