"""Personal data in texts: base patterns, and spans of a semi-Markov conditional random field."""

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import bound_batches, packed, table
from clinflow.session import send_by_value, written

send_by_value(__name__)

BASE_KINDS = ["email", "ip", "card", "phone"]
#: What the field can call a segment; `other` is a single atom outside all spans.
KINDS = ["other", *BASE_KINDS, "secret"]
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Atoms of a segment at most; islands of text around digits and @ are cut in atoms.
LONGEST = 16
#: Atoms of an island that the field learns from at most.
LESSON_ATOMS = 64
ISLAND = re.compile(r"[^\s]*[0-9@][^\s]*(?:[ \t][^\s]*[0-9@][^\s]*)*")
ATOM = re.compile(r"[0-9A-Za-z]+|\s+|.", re.S)
KEY = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[0-9A-Za-z]{16,}")
#: Islands of each seeded kind, and of none, that the field is fitted on at most, chosen by a hash of their text.
SAMPLE_ISLANDS = 150
EPOCHS = 5
RATE = 0.3
#: A span is added if its score is so much above that of its atoms outside spans.
LEAST_MARGIN = 2.0


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, found from each @ in linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > free and text[first - 1] in LOCAL:
            first -= 1
        domain = DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            free = domain.end()
            yield first, free
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order; kinds are places in `BASE_KINDS`."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def islands(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, island, word before): runs of words with a digit or @ on a line."""
    for m in ISLAND.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()].lower().split()
        words = [w for w in ("".join(c for c in x if c.isalpha()) for x in before[-2:]) if w]
        yield m.start(), m[0], words[-1] if words else ""


def shape(atom: str) -> str:
    if atom.isspace():
        return "_"
    if atom.isdigit() and atom.isascii():
        return "d"
    if atom.isalpha():
        return "a"
    return "x" if atom.isalnum() else atom


def segment_features(atoms: list[str], shapes: list[str], first: int, last: int, before: str) -> list[str]:
    """Features of the whole segment atoms[first:last]."""
    text = "".join(atoms[first:last])
    digits = only_digits(text)
    pattern = "".join(shapes[first:last])
    letters = sum(c.isalpha() for c in text)
    left = shapes[first - 1] if first else "^"
    right = shapes[last] if last < len(atoms) else "$"
    out = [
        "any", f"n{last - first}", f"shape {pattern}", f"kinds {''.join(sorted(set(pattern)))}",
        f"digits {min(len(digits), 20)}", f"letters {min(letters // 4, 6)}", f"edge {pattern[0]}{pattern[-1]}", f"out {left}{right}",
    ]
    if digits and not letters:
        out.append(f"dial {9 <= len(digits) <= 15}")
    if "@" in text:
        out.append(f"at {text.count('@')} {'.' in text.rpartition('@')[2]}")
    if 12 <= len(digits) <= 19 and not letters:
        out.append(f"luhn {luhn(digits)}")
    if pattern == "d.d.d.d":
        out.append(f"bytes {all(int(p[:4]) <= 255 for p in text.split('.'))}")
    if first == 0 and before:
        out.append(f"before {before}")
    if last - first == 1 and "x" in pattern:
        out.append(f"key {min(len(text), 40) // 4} {text.islower()}{text.isupper()}")
    return out


class Field:
    """Weights of (feature, kind). The score of a segmentation is the sum over its segments."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}

    def lattice(self, atoms: list[str], before: str) -> list[list[tuple[int, list[str], np.ndarray]]]:
        """For each end, the (start, features, scores by kind) of its segments. Spans don't begin or end with white space."""
        shapes = [shape(a) for a in atoms]
        out: list[list[tuple[int, list[str], np.ndarray]]] = [[]]
        zero = [0.0] * len(KINDS)
        for last in range(1, len(atoms) + 1):
            ways = []
            for first in range(max(0, last - LONGEST), last):
                single = last - first == 1
                if not single and "_" in (shapes[first], shapes[last - 1]):
                    continue
                names = segment_features(atoms, shapes, first, last, before)
                score = np.sum([self.weights.get(name, zero) for name in names], axis=0)
                if not single:
                    score[0] = -np.inf
                if single and shapes[first] == "_":
                    score[1:] = -np.inf
                ways.append((first, names, score))
            out.append(ways)
        return out

    def best(self, atoms: list[str], before: str) -> list[tuple[int, int, int, float]]:
        """(first, last, kind, margin) of the spans of the best segmentation, by dynamic programming."""
        ways = self.lattice(atoms, before)
        total, back, outside = [0.0], [(0, 0)], [0.0]
        for last in range(1, len(ways)):
            total.append(-math.inf)
            back.append((0, 0))
            for first, _, score in ways[last]:
                kind = int(score.argmax())
                if total[first] + score[kind] > total[last]:
                    total[last], back[last] = total[first] + score[kind], (first, kind)
                if first == last - 1:
                    outside.append(outside[-1] + score[0])
        spans, last = [], len(atoms)
        while last:
            first, kind = back[last]
            if kind:
                spans.append((first, last, kind, total[last] - total[first] - (outside[last] - outside[first])))
            last = first
        return spans[::-1]

    def step(self, atoms: list[str], before: str, gold: dict[tuple[int, int], int], squares: dict[str, np.ndarray]) -> None:
        """One step up the log likelihood of a segmentation; expected counts come from the forward and backward sums."""
        ways = self.lattice(atoms, before)
        n = len(atoms)
        ahead = np.full(n + 1, -np.inf)
        ahead[0] = 0
        for last in range(1, n + 1):
            ahead[last] = np.logaddexp.reduce([ahead[first] + np.logaddexp.reduce(score) for first, _, score in ways[last]])
        behind = np.full(n + 1, -np.inf)
        behind[n] = 0
        for last in range(n, 0, -1):
            for first, _, score in ways[last]:
                behind[first] = np.logaddexp(behind[first], behind[last] + np.logaddexp.reduce(score))
        pull: dict[str, np.ndarray] = {}
        for last in range(1, n + 1):
            for first, names, score in ways[last]:
                change = -np.exp(ahead[first] + score + behind[last] - ahead[n])
                kind = gold.get((first, last))
                if kind is not None:
                    change[kind] += 1
                if np.abs(change).max() > 1e-4:
                    for name in names:
                        pull[name] = pull[name] + change if name in pull else change.copy()
        for name, change in pull.items():
            squares[name] = squares.get(name, 1e-2) + change * change
            held = self.weights.get(name)
            moved = RATE * change / np.sqrt(squares[name])
            self.weights[name] = (moved if held is None else np.asarray(held) * 0.9999 + moved).tolist()


def gold_segments(atoms: list[str], spans: list[tuple[int, int, int]]) -> dict[tuple[int, int], int] | None:
    """The segmentation that (start, kind, end) in characters of the island make; None if they don't fit the atoms."""
    ends = np.cumsum([len(a) for a in atoms]).tolist()
    starts = [0, *ends[:-1]]
    gold: dict[tuple[int, int], int] = {}
    free = 0
    for start, kind, end in spans:
        if start not in starts or end not in ends:
            return None
        first, last = starts.index(start), ends.index(end) + 1
        if first < free or last - first > LONGEST:
            return None
        gold |= {(k, k + 1): 0 for k in range(free, first)}
        gold[first, last] = kind
        free = last
    return gold | {(k, k + 1): 0 for k in range(free, len(atoms))}


def seeds(island: str) -> list[tuple[int, int, int]]:
    """Spans that the field learns from: the base patterns, and long runs of mixed letters and digits as secrets."""
    found = [(start, kind + 1, end) for start, kind, end in base_spans(island)]
    for m in KEY.finditer(island):
        if all(m.end() <= start or end <= m.start() for start, _, end in found):
            found.append((m.start(), KINDS.index("secret"), m.end()))
    return sorted(found)


def lesson(island: str, before: str) -> tuple | None:
    """(atoms, word before, gold segmentation) of an island that the field can learn from."""
    atoms = ATOM.findall(island)
    gold = gold_segments(atoms, seeds(island)) if len(atoms) <= LESSON_ATOMS else None
    return None if gold is None else (atoms, before, gold)


def kinds_of(island: str) -> list[int]:
    """The kinds of an island's seeds, 0 for one without; none for an island that is no lesson."""
    learned = lesson(island, "")
    return [] if learned is None else sorted(set(learned[2].values()) - {0}) or [0]


def side_by_side(left: tuple, right: tuple) -> tuple:
    """One lesson from two: the atoms of both with a space between."""
    at = len(left[0]) + 1
    gold = left[2] | {(at - 1, at): 0} | {(first + at, last + at): kind for (first, last), kind in right[2].items()}
    return [*left[0], " ", *right[0]], left[1], gold


def fitted(sample: list[tuple[str, str]]) -> Field:
    """The field of (island, word before), in the order given; neighbours are also shown as one island."""
    field, squares = Field(), {}
    lessons = [x for x in (lesson(island, before) for island, before in sample) if x is not None]
    lessons += [side_by_side(a, b) for a, b in zip(lessons, lessons[1:]) if len(a[0]) + len(b[0]) < LESSON_ATOMS]
    for _ in range(EPOCHS):
        for atoms, before, gold in lessons:
            field.step(atoms, before, gold, squares)
    return field


def added_spans(field: Field, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the field's spans that no base span overlaps."""
    found = []
    taken = [(start, end) for start, _, end in base]
    for start, island, before in islands(text):
        atoms = ATOM.findall(island)
        ends = np.cumsum([len(a) for a in atoms]).tolist()
        for first, last, kind, margin in field.best(atoms, before):
            a, b = start + (ends[first - 1] if first else 0), start + ends[last - 1]
            if margin >= LEAST_MARGIN and all(b <= s or e <= a for s, e in taken):
                found.append((a, kind - 1, b))
    return found


def sampled(docs: DataFrame) -> list[tuple[str, str]]:
    """At most `SAMPLE_ISLANDS` different islands of the corpus of each kind in `KINDS`, those of the least hashes.

    An island is of all kinds that its seeds have, or of the kind `other` if it has none. Only islands that
    can be lessons are counted, so every kind that the corpus has usable examples of is learned,
    whatever else the corpus holds.
    """

    @F.pandas_udf("array<struct<island: string, before: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"island": x, "before": y} for _, x, y in islands(text)] for text in texts])

    @F.pandas_udf("array<int>")
    def kinds(found: pd.Series) -> pd.Series:
        return pd.Series([kinds_of(island) for island in found])

    marked = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    rows = marked.select(F.explode(cut("text")).alias("x")).select("x.*").distinct()
    hashed = rows.select(F.xxhash64("island", "before").alias("h"), "island", "before", F.explode(kinds("island")).alias("kind"))
    hashed = written(hashed, "pii-islands")
    chosen = [hashed.where(F.col("kind") == k).orderBy("h", "island", "before").limit(SAMPLE_ISLANDS) for k in range(len(KINDS))]
    every = chosen[0]
    for part in chosen[1:]:
        every = every.unionByName(part)
    found = sorted({(r.h, r.island, r.before) for r in every.collect()})  # at most SAMPLE_ISLANDS of each kind
    return [(island, before) for _, island, before in found]


def found_spans(docs: DataFrame) -> DataFrame:
    """The whole rows of `docs` as `_row`, with `_pii`: counts of the base kinds, the digest of the base spans, and all spans as text.

    Base spans are the leftmost matches of each kind that don't overlap, checked by length, range or Luhn.
    The field reads islands of words with a digit or an @: every segment of up to 16 atoms has features of the
    whole segment, and one dynamic program chooses boundaries and kinds together. It is fitted by likelihood on at
    most `SAMPLE_ISLANDS` islands of each kind in the corpus, and as many without one, whose labels are the base patterns and long mixed keys, and adds
    spans that overlap no base span: telephone numbers with digits after them, cards and addresses in other
    forms, and keys, as kind `secret`.

    A null text counts as empty: no spans. Texts are read whole. Rows that repeat get equal spans. An empty
    table gives no rows.
    """
    bound_batches(docs.sparkSession)
    field = fitted(sampled(docs))
    weights = docs.sparkSession.sparkContext.broadcast(field.weights)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = Field(weights.value)
        names = [*BASE_KINDS, "secret"]
        write = lambda spans: ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in spans)
        for batch in batches:
            rows = []
            for text in batch:
                base = base_spans(text) if text else []
                added = added_spans(held, text, base) if text else []
                counts = [sum(kind == k for _, kind, _ in base) for k in range(4)]
                rows.append((*counts, hashlib.sha256(write(base).encode()).hexdigest(), write(sorted(base + added))))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return packed(docs).withColumn("_pii", find(F.coalesce("_row.text", F.lit(""))))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("_row.doc_id", "_pii.*")
