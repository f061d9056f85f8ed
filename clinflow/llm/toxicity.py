"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import bound_batches, table
from clinflow.llm.hashing import blocks, codes_of
from clinflow.session import send_by_value, written

send_by_value(__name__)

#: Letters are folded to so many codes; code 0 is what no subsequence may use (marks, symbols), and the last
#: code is the edge of a word.
ALPHABET = 64
EDGE = ALPHABET - 1
#: Places of the second and third letter of a subsequence after its first: up to two inserted characters.
GAPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
DECAY = 0.6
LANDMARKS = 160
#: Bounds of the labelled rows and words that the model is fitted on.
SAMPLE_ROWS = 40_000
SAMPLE_WORDS = 3_000
LEAST_DOCUMENTS = 3
LEAST_SHARE = 0.015
#: Rounds in which the words of other texts with the largest margins become negative instances.
HARD_ROUNDS = 3
STEPS = 50
PENALTY = 3e-3


def letter_codes() -> np.ndarray:
    """Code of each character below U+0250: letters without case; 0 for all else."""
    table = np.zeros(0x250, np.int64)
    for c in range(0x250):
        low = chr(c).lower()[:1]
        if low.isalpha():
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 7) % (EDGE - 27)
    return table


CODES = letter_codes()
#: Digits and symbols that stand for letters, where another letter follows.
STAND_INS = dict(zip("013457@$!", "oieastasi"))
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0])


def segments(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, segment): folded letters with an edge before and after each segment, and the number of the
    segment that begins or goes on at each place.

    A segment is a run without white space, less the marks at its ends; or a run of single characters with one
    space between, so that letters that are set apart are read together.
    """
    codes = np.concatenate(([32], codes, [32]))
    space = np.isin(codes, SPACES)
    padded = np.concatenate(([True, True], space, [True, True]))
    alone = ~padded[2:-2] & padded[1:-3] & padded[3:-1]
    sides = np.concatenate(([False], alone, [False]))
    breaks = space & ~(sides[:-2] & sides[2:])
    letters = np.where(codes < 0x250, CODES[np.minimum(codes, 0x24F)], np.where(codes < 0x2000, 27 + codes % (EDGE - 27), 0))
    followed = np.concatenate((letters[1:] > 0, [False]))
    for symbol, letter in STAND_INS.items():
        letters[(codes == ord(symbol)) & followed] = ord(letter) - 96
    marks = letters == 0
    run = np.cumsum(np.concatenate(([True], marks[1:] != marks[:-1]))) - 1
    edge = marks & (np.bincount(run, weights=breaks)[run] > 0)  # marks next to a break belong to it
    letters[edge] = EDGE
    return letters, np.cumsum(edge)


def subsequences(letters: np.ndarray, segment: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, codes, weight) of the triples of each gap pattern that lie in one segment with its edges."""
    n = len(letters)
    for second, third in GAPS:
        if n <= third:
            return
        a, b, c = letters[: n - third], letters[second : n - third + second], letters[third:]
        inside = segment[third - 1 : n - 1] == segment[: n - third]  # no edge between the first and the third
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0) & inside & ((a != EDGE) | (c != EDGE)))
        yield at, (a[at] * ALPHABET + b[at]) * ALPHABET + c[at], DECAY ** (third - 2)


def features(words: list[str]) -> list[dict[int, float]]:
    """The kernel's feature map of each word, of length 1: a weight for each triple that occurs in it with gaps."""
    found = []
    for word in words:
        letters, segment = segments(codes_of(word))
        held: dict[int, float] = {}
        length = 0.0
        for _, triples, weight in subsequences(letters, segment):
            length += weight * weight * len(triples)
            for t in triples.tolist():
                held[t] = held.get(t, 0.0) + weight
        found.append({t: w / np.sqrt(length) for t, w in held.items()} if length else {})
    return found


def kernel(left: list[dict[int, float]], right: list[dict[int, float]]) -> np.ndarray:
    """Inner products of feature maps, over an index of the right side's triples."""
    index: dict[int, list[tuple[int, float]]] = {}
    for j, held in enumerate(right):
        for t, w in held.items():
            index.setdefault(t, []).append((j, w))
    out = np.zeros((len(left), len(right)))
    for i, held in enumerate(left):
        for t, w in held.items():
            for j, v in index.get(t, ()):
                out[i, j] += w * v
    return out


@dataclass
class Model:
    """weights: of each triple, the machine's normal carried back through landmarks; scale, shift: of the score."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def margins(self, texts: list[str]) -> np.ndarray:
        """The largest margin among the segments of each text."""
        out = np.full(len(texts), min(self.bias, 0.0))
        for first, last in blocks(texts):
            parts = [codes_of(text) for text in texts[first:last]]
            joined = np.concatenate([x for part in parts for x in (part, [32])])
            letters, segment = segments(joined)
            bounds = np.cumsum([len(part) + 1 for part in parts])  # a text's segments end at the edge after it
            total = np.zeros(int(segment[-1]) + 1)
            length, place = np.zeros(len(total)), np.zeros(len(total), np.int64)
            for at, triples, weight in subsequences(letters, segment):
                held = segment[at]
                total += weight * np.bincount(held, weights=self.weights[triples], minlength=len(total))
                length += weight * weight * np.bincount(held, minlength=len(total))
                place[held] = np.maximum(place[held], at)
            scored = np.flatnonzero(length > 0)
            margin = total[scored] / np.sqrt(length[scored]) + self.bias
            # `segments` puts one edge in front; the last place of a segment's triples lies before its text's end
            np.maximum.at(out, first + np.searchsorted(bounds, place[scored], side="left"), margin)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.margins(texts) - self.shift), -30, 30)))


def squared_hinge(points: np.ndarray, sides: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """(normal, bias) of the machine with squared hinge loss, by Newton steps on the points within the margin."""
    held = np.hstack([points, np.ones((len(points), 1))])
    ridge = np.diag(np.append(np.full(points.shape[1], PENALTY), 1e-9))
    normal, within = np.zeros(held.shape[1]), np.zeros(len(held), bool)
    for _ in range(STEPS):
        now = sides * (held @ normal) < 1
        if (now == within).all():
            break
        within = now
        weighted = held[within] * (cost[within] / len(held))[:, None]
        normal = np.linalg.solve(weighted.T @ held[within] + ridge, weighted.T @ sides[within])
    return normal[:-1], float(normal[-1])


def fitted(positive: list[str], negative: list[str]) -> Model:
    """The machine of two lists of words; both in order of importance."""
    if not positive or not negative:
        return Model(np.zeros(ALPHABET**3), -1.0, 4.0, 0.0)
    words = positive + negative
    maps = features(words)
    half = LANDMARKS // 2
    marks = maps[: min(half, len(positive))] + maps[len(positive) : len(positive) + half]
    middle = kernel(marks, marks)
    values, vectors = np.linalg.eigh(middle)
    kept = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, kept] / np.sqrt(values[kept])
    points = kernel(maps, marks) @ root
    sides = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.where(sides > 0, len(words) / (2 * len(positive)), len(words) / (2 * len(negative)))
    normal, bias = squared_hinge(points, sides, cost)
    weights = np.zeros(ALPHABET**3)
    for alpha, held in zip(root @ normal, marks):
        for t, w in held.items():
            weights[t] += alpha * w
    return Model(weights, float(bias), 6.0, 0.0)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): the training rows, at most `SAMPLE_ROWS` of each class, by a hash of the id.

    Only ids whose crc32 isn't divisible by 5 are used.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [usable.where(F.col("toxic") == side).orderBy(*order).limit(SAMPLE_ROWS) for side in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # at most 80,000 ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows.

    The words of labelled texts are counted by document and label. Positive instances are words that are in
    at least `LEAST_DOCUMENTS` and a share of `LEAST_SHARE` of the toxic texts, and 20 times as frequent there as in
    the others. Negative ones are the most frequent words of the others, and then, in rounds, those with the largest margins.
    At most `SAMPLE_WORDS` of each kind come to the driver. The shift of the score is set between the
    margins of the two kinds of training texts, where fewest are on the wrong side.
    """
    sample = labelled(docs, labels)
    plain = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}[\p{L}\p{Nd}]*)"), F.lit(1)))
    counts = written(sample.select("toxic", F.explode(plain).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")), "toxic-words")
    totals = sample.agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).first()
    yes, no = (totals.yes or 0) + 1, (totals.no or 0) + 1
    often = counts.where((F.length("word") > 2) & (F.col("yes") >= max(LEAST_DOCUMENTS, LEAST_SHARE * yes)) & F.expr(f"yes / {yes} > 20 * (no + 0.05) / {no}"))
    positive = [r.word for r in often.orderBy(F.desc("yes"), "word").limit(SAMPLE_WORDS).collect()]
    other = counts.where(f"no > 0 and yes / {yes} < 3 * no / {no}")
    negative = [r.word for r in other.orderBy(F.desc("no"), "word").limit(SAMPLE_WORDS).collect()]
    model = fitted(positive, negative)
    for _ in range(HARD_ROUNDS if positive else 0):
        worst = other.withColumn("m", margin_column(model)("word")).orderBy(F.desc("m"), "word").limit(SAMPLE_WORDS // 4)
        hard = [r.word for r in worst.collect()]
        negative = list(dict.fromkeys([*hard[: LANDMARKS // 4], *negative, *hard]))
        model = fitted(positive, negative)
    margins = sample.select("toxic", margin_column(model)("text").alias("m")).groupBy(
        "toxic", F.round("m", 2).alias("m")).agg(F.count("*").alias("n")).collect()  # bounded by the range of margins
    return shifted(model, [(r.toxic, r.m, r.n) for r in margins])


def shifted(model: Model, margins: list[tuple[int, float, int]]) -> Model:
    """`model` with the shift that leaves the least sum of both error rates, in the middle of the best gap."""
    all_yes = sum(n for side, _, n in margins if side) or 1
    all_no = sum(n for side, _, n in margins if not side) or 1
    values = sorted({m for _, m, _ in margins})
    best, at = None, model.shift
    for low, high in zip(values, values[1:]):
        cut = (low + high) / 2
        wrong = sum(n for s, m, n in margins if s and m < cut) / all_yes + sum(n for s, m, n in margins if not s and m > cut) / all_no
        if best is None or (wrong, low - high) < best:
            best, at = (wrong, low - high), cut
    return Model(model.weights, model.bias, model.scale, at)


def margin_column(model: Model):
    sent = model

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.margins(list(texts)))

    return margin


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    The kernel of two words counts the triples of letters they share in order, with up to two
    characters inserted, each less by the decay; letters set apart by single spaces are one word, digits and symbols
    stand for the letters they replace. The machine is trained on words; carried back
    through the Nyström landmarks it is one weight per triple, so a text is scored whole, and its score is that
    of its largest segment, through a logistic curve. Only the text is an input of the score.

    Null and empty texts score as texts without a segment. Rows that repeat get equal scores. Without
    labels of both kinds all scores are low. A null doc_id is not held out. Other columns are not read.
    """
    bound_batches(docs.sparkSession, "2m")
    model = trained(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)))

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
                       score(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
