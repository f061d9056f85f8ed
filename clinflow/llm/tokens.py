"""Token ids of documents as Parquet list columns that can be read in part."""

import os
import struct
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import bound_batches, partitions_of, prefix_sums, table
from clinflow.session import run_dir, send_by_value, written

send_by_value(__name__)

END_ID = 1
#: Words whose ids a worker process remembers.
KNOWN_WORDS = 500_000
#: How the files are written. Ids repeat and stay in a dictionary; keys and counts are stored as deltas (pages
#: of version 2 without a dictionary). Row groups and pages are small, and each page has its place and bounds
#: in the page index, so that a range of doc_id, or the counts alone, can be read without the ids.
FILE_OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 * 1024 * 1024),
    "parquet.page.size": str(256 * 1024),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(1024 * 1024),
    "compression": "zstd",
}


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in turn from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTES = byte_characters()
BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
#: Bytes of text at once.
BLOCK_BYTES = 4_000_000


class Encoder:
    """Encodes texts word by word and remembers the words.

    The tokenizer drops white space and cuts at it before all else, so the ids of a text are those of its
    runs between blanks, one after another. Only space, tab, line feed and return are taken as blanks here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {mark: as_bytes(self.tokenizer.encode(mark, add_special_tokens=False).ids) for mark in (".", ",")}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.cores: dict[str, bytes] = {}
        self.ids = np.array([END_ID], np.int32)  # entry 0 is the end of a text, which no word stands for
        self.first = np.array([0, 1], np.int32)

    def learn(self, words: list[str]) -> None:
        """Ids of new words. Latin letters, with a full stop or comma after them or not, go straight to the model:
        the steps before it only put them in lower case, cut the mark off and write their bytes as characters."""
        found: list[bytes] = []
        others = []
        tokenize, cores, marks = self.tokenizer.model.tokenize, self.cores, self.marks
        for word in words:
            after = marks.get(word[-1:])
            core = word[:-1] if after else word
            if core.isalpha() and (core.isascii() or max(core) < "\u0180" and "\u0130" not in core):
                core = core.lower()
                ids = cores.get(core)
                if ids is None:
                    shown = core if core.isascii() else "".join([BYTES[b] for b in core.encode()])
                    ids = cores[core] = as_bytes([t.id for t in tokenize(shown)])
                found.append(ids + after if after else ids)
            else:
                others.append(len(found))
                found.append(b"")
        for k, e in zip(others, self.tokenizer.encode_batch_fast([words[k] for k in others], add_special_tokens=False)):
            found[k] = as_bytes(e.ids)
        self.known.update(zip(words, range(len(self.first) - 1, len(self.first) - 1 + len(words))))
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<i4")])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes, dtype=np.int32)])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, each with the end id after it, and where each text ends.

        Arrow cuts the texts and numbers their words; only the different words of a block are Python strings.
        """
        parts = pc.split_pattern(with_blanks(texts), " ")
        coded = pc.dictionary_encode(parts.flatten())
        words = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        known = self.known.get
        entries = np.array([known(word, -1) for word in words], np.int32)
        new = np.flatnonzero(entries < 0)
        if len(new):
            entries[new] = np.arange(len(self.first) - 1, len(self.first) - 1 + len(new))
            self.learn([words[k] for k in new.tolist()])
        offsets = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        at = np.insert(entries[coded.indices.to_numpy()], offsets, 0)
        size = np.diff(self.first)[at]
        sums = np.zeros(len(at) + 1, np.int32)
        np.cumsum(size, out=sums[1:])
        places = np.repeat(self.first[at] - sums[:-1], size)
        places += np.arange(len(places), dtype=np.int32)
        return self.ids[places], sums[offsets + np.arange(1, len(offsets) + 1)]


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process, so that its tasks share the words they have met."""
    held = sys.modules.setdefault("clinflow_encoders", ModuleType("clinflow_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def blocks_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts that together have about `BLOCK_BYTES`."""
    if len(sizes):
        run = (np.cumsum(sizes, dtype=np.int64) - sizes) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
        yield from zip(cuts, cuts[1:])


def with_blanks(texts: pa.StringArray) -> pa.StringArray:
    """The texts with a space for every tab, line feed and return: bytes of UTF-8 below 128 stand for themselves alone."""
    _, offsets, data = texts.buffers()
    plain = (data.to_pybytes() if data else b"").translate(BLANKS)
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(plain), None, 0, texts.offset)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, tokens) in the order of doc_id."""
    bound_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            texts = batch.column("text")
            for first, last in blocks_of(pc.binary_length(texts).to_numpy()):
                ids, ends = encoder.encode(pa.concat_arrays([texts.slice(first, last - first)]))
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(np.diff(offsets).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))],
                    names=["doc_id", "n_tokens", "tokens"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_tie"))
    placed = rows.repartitionByRange(partitions_of(docs.sparkSession), "doc_id", "_tie")
    ordered = placed.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return ordered.mapInArrow(encode, "doc_id long, n_tokens long, tokens array<int>")


def write_tokens(docs: DataFrame, path: str, folder: str) -> None:
    """Encodes `docs` with the tokenizer file at `path` and writes the ids to `folder`.

    Files, and rows in them, ascend in doc_id; null ids come first, rows that share an id follow a hash of
    their text. Every text is encoded whole, without special tokens, and ends with the id `END_ID`; null
    is an empty text, which has that id alone. An empty table writes files without rows. Other
    columns are not read.
    """
    encoded(docs, path).write.options(**FILE_OPTIONS).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, start) and, with `ids`, the checksum of the ids (`ids_crc32`) from written files.

    `start` is the number of ids in all rows before, in the order of the files. Without `ids` the list
    column is not read.
    """
    rows = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(folder)
    placed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            ends = 4 * lists.offsets.to_numpy().astype(np.int64)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            kept = [batch.column(name) for name in ("doc_id", "n_tokens", "file", "row")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], names=["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    if ids:
        bound_batches(spark)
        sums = placed.mapInArrow(checksums, "doc_id long, n_tokens long, file string, row long, ids_crc32 long")
        placed = written(sums, "token-sums")  # narrow rows: what comes next reads its input twice
    else:
        placed = placed.drop("tokens")
    return prefix_sums(placed, ["file", "row"], "n_tokens", "token-starts").withColumnRenamed("before", "start").drop(
        "rank", "total", "file", "row")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
