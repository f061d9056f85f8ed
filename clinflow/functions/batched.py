"""The two Arrow-batched functions Spark has no expression for."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F

from clinflow.session import send_by_value

send_by_value(__name__)

BEST_MATCH = "struct<feature:string,score:double>"


def best_ratio(cutoff: float):
    """(term, candidates) to the best candidate by matching-block ratio, or null.

    Equal ratios go to the lexicographically larger name.
    """

    @F.pandas_udf(BEST_MATCH)
    def best(term: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        rows = []
        matcher = difflib.SequenceMatcher()
        for word, names in zip(term, candidates):
            matcher.set_seq2(word)
            top = (None, None)
            for name in names:
                matcher.set_seq1(name)
                floor = cutoff if top[1] is None else top[1]
                if matcher.real_quick_ratio() < floor or matcher.quick_ratio() < floor:
                    continue
                score = matcher.ratio()
                if score >= cutoff and (top[1] is None or (score, name) > (top[1], top[0])):
                    top = (name, score)
            rows.append(top)
        return pd.DataFrame(rows, columns=["feature", "score"]).astype({"feature": object, "score": float})

    return best


SEPARATORS = ["\n\n", "\n", " ", ""]


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of the text; each part after the first keeps the separator in front."""
    if separator == "":
        return list(text)
    first, *rest = text.split(separator)
    return [part for part in [first, *(separator + part for part in rest)] if part]


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Join parts to chunks of at most `size`, carrying up to `overlap` into the next."""
    chunks, window, width = [], [], 0
    for part in parts:
        if window and width + len(part) > size:
            chunks.append("".join(window).strip())
            while window and (width > overlap or width + len(part) > size):
                width -= len(window.pop(0))
        window.append(part)
        width += len(part)
    if window:
        chunks.append("".join(window).strip())
    return [chunk for chunk in chunks if chunk]


def boundary_chunks_of(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    at = next(i for i, mark in enumerate(separators) if mark == "" or mark in text)
    out, short = [], []
    for part in _pieces(text, separators[at]):
        if len(part) < size:
            short.append(part)
            continue
        out += _packed(short, size, overlap)
        short = []
        finer = separators[at + 1:]
        out += boundary_chunks_of(part, size, overlap, finer) if finer else [part]
    return out + _packed(short, size, overlap)


def boundary_chunks(size: int = 500, overlap: int = 50):
    """Chunks that prefer paragraph, line and word boundaries."""

    @F.pandas_udf("array<string>")
    def chunks(text: pd.Series) -> pd.Series:
        return text.map(lambda value: boundary_chunks_of(value, size, overlap) if value else [])

    return chunks
