import math
import random
import re
from collections import Counter

import pytest
from clinflow.llm import quality

BLANK = r"[\x20\x09-\x0D]+"


def brute_base(text):
    text = text or ""
    words = [w for w in re.split(BLANK, text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.sub(BLANK, "", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def texts():
    rng = random.Random(7)
    clean = [" ".join(rng.choice("the of and to reads well plain words here now".split()) + rng.choice(["", ",", "."]) for _ in range(200))
             for _ in range(60)]
    junk = [" ".join(rng.choice("the of and to".split()) + rng.choice(["$$$", "!!!", "***"]) for _ in range(200)) for _ in range(12)]
    return clean + junk + ["a a a a a\n\na a a a a", "x\nx\n \nx", "one two \x1cthree é#|<>", " ".join("abcabdabc" * 30)]


@pytest.fixture
def judged(documents, spark):
    rows = texts()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(60, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, documents(*rows), labels


def test_base_equals_brute_force(judged):
    rows, docs, labels = judged
    for r in quality.judged(docs, labels).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_base(rows[r._row.doc_id])


def test_ratio_equals_brute_force(judged, spark):
    rows, docs, labels = judged
    b = quality.BUCKETS
    words = {w for t in rows for w in re.split(BLANK, t) if w}
    hashed = {r.w: (r.h % b, r.t % b + b) for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr(
        "w", "xxhash64(w) h", "xxhash64(right(w, 3)) t").collect()}
    grams = [[g for w in re.split(BLANK, t) if w for g in hashed[w]] for t in rows]
    raw, target = Counter(), Counter()
    for i, found in enumerate(grams):
        raw.update(found)
        if i < 60 and i % 2 == 0:
            target.update(found)
    total = lambda counts, kind: sum(n for g, n in counts.items() if g // b == kind)
    share = lambda counts, g: math.log((counts[g] + 1) / (total(counts, g // b) + b))
    for r in quality.judged(docs, labels).collect():
        found = grams[r._row.doc_id]
        want = sum(share(target, g) - share(raw, g) for g in found) / len(found) if found else 0.0
        assert r.ratio == pytest.approx(want, abs=1e-5)
        assert r.kept == (not r.base_failed and r.ratio >= quality.LEAST_RATIO)
        if r._row.doc_id < 60:
            assert r.kept
        elif r._row.doc_id < 72:
            assert not r.kept


def test_odd_rows(odd, documents, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    found = quality.judged(odd, labels)
    assert found.count() == odd.count()
    assert found.where("_row.text is null and (n_words > 0 or kept)").count() == 0
    assert quality.judged(documents(), labels).count() == 0
    assert quality.judged(documents("a b"), labels.limit(0)).collect()[0].ratio == 0
