import random

import numpy as np
import pyarrow as pa
import pytest
from clinflow.llm import lines
from clinflow.llm.hashing import band_keys


def bag(line):
    return {line[i : i + 5] for i in range(max(len(line) - 4, 1))}


def brute(texts):
    found = [((d, k), bag(x)) for d, text in enumerate(texts) for k, x in enumerate((text or "").split("\n")) if x.strip()]
    root = {key: key for key, _ in found}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(found):
        for b, y in found[i + 1 :]:
            if len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {key: find(key) for key in root}


def corpus():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([8, 40, 120]))).strip() or "x" for _ in range(40)]
    texts = []
    for _ in range(60):
        picked = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 3])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            picked.append("".join(line))
        texts.append("\n".join(picked))
    return texts + [None, "", "\n \n", "abc\nabc\nabd", "x"]


def test_classes_equal_brute_force(documents):
    texts = corpus()
    found = {(r.doc_id, r.line): divmod(int(r.class_id), lines.LINE) for r in lines.line_classes(documents(*texts)).collect()}
    assert found == brute(texts)


def test_one_line_of_a_class_stays(documents):
    texts = corpus()
    want = brute(texts)
    docs = documents(*texts)
    for r in lines.deduplicated(docs).collect():
        mine = {k: v for k, v in want.items() if k[0] == r.doc_id}
        assert r.n_lines == len(mine)
        assert [(d.line, d.kept_doc, d.kept_line) for d in r.dropped] == [(k[1], *v) for k, v in sorted(mine.items()) if k != v]
        assert r.n_dropped == len(r.dropped)
    for r in lines.without_repeats(docs).collect():
        text = texts[r.doc_id]
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if want.get((r.doc_id, k), (r.doc_id, k)) == (r.doc_id, k))
        assert r.text == kept


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 900).astype(np.uint64)
    left, right = hashes[:600], hashes[200:800]
    for size, part in ((2048, slice(None)), (2048, slice(0, None, 40))):
        a, b = (lines.min_hash(np.zeros(len(x[part]), np.int64), x[part], 1, size)[0] for x in (left, right))
        want = len(set(left[part]) & set(right[part])) / len(set(left[part]) | set(right[part]))
        assert abs((a == b).mean() - want) < (0.05 if part == slice(None) else 0.2)


def test_odd_rows(odd, documents):
    found = lines.deduplicated(odd).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3, 4, 5, 6]
    assert {r.doc_id: r.n_lines for r in found if r.doc_id != 5} == {1: 0, 2: 0, 3: 0, 4: 2, 6: 1}
    assert lines.deduplicated(documents()).count() == 0


@pytest.mark.parametrize("shingles", [18, 36, 72])
def test_bands_miss_few_pairs_at_the_threshold(shingles):
    rng, n = np.random.default_rng(1), 20_000
    shared = shingles * 8 // 9  # of each side's shingles, so that the Jaccard is 0.8
    own = shingles - shared
    hashes = rng.integers(0, 2**63, (n, shared + 2 * own)).astype(np.uint64)
    sides = hashes[:, :shingles], np.concatenate([hashes[:, :shared], hashes[:, shingles:]], axis=1)
    left, right = (band_keys(lines.min_hash(np.repeat(np.arange(n), shingles), x.ravel(), n, lines.BANDS * lines.ROWS), lines.BANDS, lines.ROWS)
                   for x in sides)
    assert 1 - (left == right).any(axis=1).mean() < 0.002


def test_lines_that_share_bands_by_chance_go_no_further(documents, monkeypatch):
    monkeypatch.setattr(lines, "KEY", 63)  # many different lines share a key
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.choice([40, 300, 500]))) for _ in range(400)]
    docs = documents(*texts, texts[0] + "a", texts[1] + "b")
    hashed = lines.hashed_lines(docs).drop("text")
    members, found = lines.buckets(docs, hashed, lines.LEAST)
    near = {r.text for r in found.collect()}
    assert {texts[0], texts[0] + "a", texts[1], texts[1] + "b"} <= near
    assert len(near) < 120 and members.count() < 20 * 120  # of 402


@pytest.mark.parametrize("shingles", [1, 9, 18, 90, 126, 135, 720])
def test_sketches_lose_no_pair_at_the_threshold(shingles):
    rng, n = np.random.default_rng(2), 5_000
    shared = shingles * 8 // 9 if shingles > 1 else 1
    own = shingles - shared
    hashes = rng.integers(0, 2**63, (n, shared + 2 * own)).astype(np.uint64)
    owner = np.repeat(np.arange(n), shingles)
    a, b = (lines.sketches(owner, x.ravel(), lines.min_hash(owner, x.ravel(), n, lines.BANDS * lines.ROWS))
            for x in (hashes[:, :shingles], np.concatenate([hashes[:, :shared], hashes[:, shingles:]], axis=1)))
    assert lines.may_be_near(a, b, lines.LEAST).all()


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_rows_of_a_key_meet_over_batches(size, monkeypatch):
    monkeypatch.setattr(lines, "RUN", 3)
    same = [0xAB << 8, 0xAB << 8, 0xAB << 8]
    far = [0, (2**56 - 1) << 8]
    runs = {1: far, 2: same, 3: [7], 4: far + [0], 5: far * 3, 6: same[:2] + [(0xAB ^ (2**56 - 1)) << 8]}
    rows = [(key, i, sketch) for key, found in runs.items() for i, sketch in enumerate(found)]
    rows = [x for row in rows for x in [row] * 2]  # equal texts
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array(np.array([r[2] for r in part], np.uint64).view(np.int64))],
        ["key", "first", "sketch"]) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
    found = [r for batch in lines.near_rows(lines.LEAST)(iter(batches)) for r in batch.to_pylist()]
    kept = {}
    for r in found:
        kept.setdefault(r["key"], set()).add(r["first"])
    # the key with more texts than RUN gives all of them, the others those with a partner
    assert sorted(map(sorted, kept.values())) == [[0, 1], [0, 1, 2], [0, 1, 2, 3, 4, 5], [0, 2]]
