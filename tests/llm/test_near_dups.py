import random
from collections import Counter

import numpy as np
from clinflow.llm import near_dups
from clinflow.llm.hashing import counted, overlaps, word_shingles


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - k + 1)) if words else Counter()


def similar(a, b):
    union = sum((a | b).values())
    return not union or sum((a & b).values()) / union >= 0.8


def brute(rows):
    bags = {i: shingles(t) for i, t in rows}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in bags:
        for b in bags:
            if a < b and similar(bags[a], bags[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([12, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(300)]
    for i in range(40):  # a chain: neighbours are near, the ends are not
        base[i * 7 : i * 7 + 2] = [word(), word()]
        texts.append(" ".join(base))
    return texts + ["", None, "  ", "few words", "Few  Words", "few words here"] + ["the same " * 40] * 3 + ["the same " * 36]


def test_classes_equal_brute_force(documents):
    rows = list(enumerate(corpus()))
    found = {r.doc_id: r.class_id for r in near_dups.groups(documents(*(t for _, t in rows))).collect()}
    assert found == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**63, 300).astype(np.uint64)
    left, right = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    want = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    parts = [(np.zeros(np.count_nonzero(c), np.int64), hashes[c > 0], c[c > 0]) for c in (left, right)]
    a, b = (near_dups.bag_min_hash(*part, 1, 4096)[0] for part in parts)
    assert abs((a == b).mean() - want) < 0.03


def test_overlap_is_exact():
    texts = corpus(4)[:30]
    texts = [t or "" for t in texts]
    pairs = [(a, b) for a in range(30) for b in range(30)]
    got = overlaps(word_shingles([texts[a] for a, _ in pairs]), word_shingles([texts[b] for _, b in pairs]), len(pairs), True)
    for (a, b), value in zip(pairs, got):
        x, y = shingles(texts[a]), shingles(texts[b])
        union = sum((x | y).values())
        assert abs(value - (sum((x & y).values()) / union if union else 1)) < 1e-9
    assert len(counted(*word_shingles([]))[0]) == 0


def test_one_of_a_class_stays(odd, documents):
    kept = near_dups.without_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted(repr(r.doc_id) for r in kept.collect())
    assert ids == sorted(map(repr, [None, None, 1, 4, 5]))  # 1, 2, 3 have no words; 4 and 6 are equal
    assert near_dups.groups(documents()).count() == 0


def test_ids_with_several_texts_join_classes(documents):
    found = near_dups.groups(documents((1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "u v w x y z", "s"), (3, "u v w x y z", "s")))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1)}
