import random
import zlib

import numpy as np
import pytest
from clinflow.llm import toxicity

BAD = ["nastyword", "dimwit", "lowlife"]


def corpus(n=900):
    rng = random.Random(5)
    parts = "ta ri mo ne lu ka si pe vo dan".split()
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def brute_kernel(a, b):
    """The kernel by enumeration of triples with gaps."""

    def features(word):
        letters = [toxicity.EDGE, *(toxicity.CODES[ord(c)] for c in word), toxicity.EDGE]
        out, length = {}, 0.0
        for i in range(len(letters)):
            for s, t in toxicity.GAPS:
                if i + t < len(letters) and not (i == 0 and i + t == len(letters) - 1):
                    key, w = (letters[i], letters[i + s], letters[i + t]), toxicity.DECAY ** (t - 2)
                    out[key] = out.get(key, 0) + w
                    length += w * w
        return {k: v / length**0.5 for k, v in out.items()} if length else {}

    x, y = features(a), features(b)
    return sum(w * y.get(k, 0) for k, w in x.items())


def test_kernel_equals_enumeration():
    words = ["dimwit", "dim", "wit", "nasty", "ab", "a", "aaaaaa", "lowlife"]
    maps = toxicity.features(words)
    got = toxicity.kernel(maps, maps)
    assert np.allclose(got, [[brute_kernel(a, b) for b in words] for a in words])
    assert np.linalg.eigvalsh(got).min() > -1e-9


def test_texts_score_alike_alone_and_together():
    model = toxicity.fitted(BAD, ["rimone", "takari", "the"])
    texts = ["", "a dimwit here", "the", "d i m w i t", "d1mwit, so", "N.A.S.T.Y.W.O.R.D", "x", "the\ntakari rimone", " "]
    together = model.margins(texts)
    assert np.allclose(together, [model.margins([t])[0] for t in texts])
    assert all(together[k] > together[2] + 0.3 for k in (1, 3, 4, 5))


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in labels}
    found = toxicity.scored(documents(*rows), table).collect()
    assert sorted(r.doc_id for r in found) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    one, two = ({r.doc_id: r.score for r in toxicity.scored(documents(*rows), spark.createDataFrame(x, schema)).collect()} for x in (labels, flipped))
    assert one == pytest.approx(two)


def test_odd_rows(spark, odd, documents):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.scored(odd, labels).collect()
    assert len(found) == odd.count() and all(r.score is not None and r.held_out is not None for r in found)
    assert toxicity.scored(documents(), labels).count() == 0
    assert toxicity.scored(documents("a", ""), labels.limit(0)).where("predicted = 1").count() == 0
