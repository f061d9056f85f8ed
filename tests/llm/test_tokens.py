import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from clinflow.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


TEXTS = ["Hello, World!\nNew\tline  two", "", "é ΑΣ Σ. I'LL don't 12 3.5 x y\x1cz \x85 end", "<|endoftext|> in<|startoftext|>side",
         " lead and trail ", "日本語 テキスト", "x" * 3000, "\r\n\x0b\x0c'S 'll"]


def test_ids_equal_the_whole_text(tokenizer):
    ids, ends = tokens.Encoder(tokens.tokenizer_path()).encode(pa.array(TEXTS))
    starts = [0, *ends[:-1]]
    for text, a, b in zip(TEXTS, starts, ends):
        assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, tokens.END_ID]


def test_words_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 3)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    for text in ["a b c d e", "f g a", "b c"]:
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_files_round_trip(spark, documents, tokenizer, tmp_path):
    rows = [(i, TEXTS[i * 5 % 8] + f" {i}", "s") for i in range(200, 0, -1)]
    folder = str(tmp_path / "tokens")
    tokens.write_tokens(documents(*rows), tokens.tokenizer_path(), folder)
    start = 0
    found = {r.doc_id: r for r in tokens.read_tokens(spark, folder).collect()}
    for doc_id, text, _ in sorted(rows):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        r = found[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    light = {r.doc_id: (r.start, r.n_tokens) for r in tokens.read_tokens(spark, folder, ids=False).collect()}
    assert light == {k: (r.start, r.n_tokens) for k, r in found.items()}
    part = pq.ParquetFile(next((tmp_path / "tokens").glob("part-*.parquet"))).metadata.row_group(0)
    kinds = {part.column(k).path_in_schema: part.column(k) for k in range(part.num_columns)}
    assert any("DICTIONARY" in e for e in kinds["tokens.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in kinds.values())


def test_odd_rows(spark, odd, documents, tmp_path):
    tokens.write_tokens(odd, tokens.tokenizer_path(), str(tmp_path / "odd"))
    found = tokens.read_tokens(spark, str(tmp_path / "odd")).collect()
    assert len(found) == odd.count()
    assert {r.n_tokens for r in found if r.doc_id in (1, 2, 3)} == {1}
    tokens.write_tokens(documents(), tokens.tokenizer_path(), str(tmp_path / "none"))
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0
