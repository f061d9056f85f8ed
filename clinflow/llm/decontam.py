"""Benchmark items in documents, found with a bounded number of edits."""

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.llm.common import bound_batches, packed, prefix_sums, table
from clinflow.session import send_by_value

send_by_value(__name__)

#: Edits that are allowed for each character of an item.
EDIT_RATE = 0.05
#: Characters in plain form from which on items are looked for: all but empty ones.
LEAST_CHARS = 1
ITEM_BLOCK_BYTES = 4 * 1024 * 1024


def plain(text: str) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """`budget` + 1 pieces (offset, text) that make up the item: with `budget` edits one stays whole."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(first, item[first:last]) for first, last in zip(cuts, cuts[1:]) if last > first]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def least_edits(item: str, at: dict[str, int], text: str) -> int:
    """The least edit distance of the item to any substring, by Myers' bit-parallel columns (1999)."""
    m = len(item)
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = every, 0, m, m
    for c in text:
        equal = at.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (every & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up, down = (up << 1) & every, (down << 1) & every
        plus = down | (every & ~(vertical | up))
        minus = up & vertical
    return best


def goes_on(text: str, at: int) -> bool:
    """Whether a word goes on from text[at - 1] to text[at]: both are digits or letters with case, whose scripts set words apart."""
    if not 0 < at < len(text):
        return False
    return all(c.isdigit() or c.lower() != c.upper() for c in text[at - 1 : at + 1])


class Finder:
    """The items of a block, with an automaton of all their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(key, text, int(len(text) * rate), masks(text)) for key, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, budget, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item, least edits) of the items that a text holds within their budgets."""
        if self.empty:
            return []
        text, windows = plain(text), {}
        whole: set[int] = set()
        for end, (length, found) in self.automaton.iter(text):
            for i, offset in found:
                if self.items[i][2]:
                    windows.setdefault(i, set()).add(end + 1 - length - offset)
                elif i not in whole and not goes_on(text, end + 1 - length) and not goes_on(text, end + 1):
                    whole.add(i)
        hits = [(self.items[i][0], 0) for i in whole]
        for i, starts in windows.items():
            key, item, budget, at = self.items[i]
            best, first, last = budget + 1, None, None
            for start in sorted(starts):
                if first is not None and start - budget > last:
                    best = min(best, least_edits(item, at, text[first:last]))
                    first = None
                if first is None:
                    first = max(start - budget, 0)
                last = start + len(item) + budget
            best = min(best, least_edits(item, at, text[first:last]))
            if best <= budget:
                hits.append((key, best))
        return hits


def item_blocks(items: DataFrame, size: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """(item_id, text, block): the items in plain order, in blocks of about `size` bytes."""
    sized = items.where("item_id is not null and text is not null").select(
        "item_id", "text", F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("_tie")).distinct()
    return prefix_sums(sized, ["item_id", "_tie"], "n", "item-blocks").select(
        "item_id", "text", F.expr(f"before div {size}").alias("block"))


def searcher(sent, rate: float):
    """A column function that gives the hits of the items that were sent."""

    @F.pandas_udf("array<struct<item_id: bigint, edits: int>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(sent.value, rate)
        for batch in batches:
            yield pd.Series([[{"item_id": k, "edits": n} for k, n in finder.find(text)] if text else [] for text in batch])

    return search


def hits(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The whole rows of `docs` as `_row`, with `_items` (item_id, edits): the items found in the text, by item_id.

    Texts are compared in plain form. An item of n characters may have floor(n * rate) edits: it is cut
    into one piece more than that, every exact hit of a piece marks a window of the text, and
    Myers' algorithm finds the least distance in the joined windows. Nothing is found if and only
    if no substring is near enough. Items that may have no edits (under 20 characters at 5 %) are found word for word:
    not within a longer word of a script that sets words apart ("art" is not in "party"), anywhere in others.
    Items that are empty in plain form are in no text.

    The benchmark is a stated query set. It goes to the tasks in blocks of bounded bytes, and each
    block is searched in all rows. Null texts hold nothing, null items are left out, items that
    share an item_id count under it. An empty benchmark finds nothing.
    """
    bound_batches(docs.sparkSession)
    numbered = item_blocks(items)
    found = packed(docs).withColumn("_items", F.expr("cast(array() as array<struct<item_id: bigint, edits: int>>)"))
    for (block,) in sorted(numbered.select("block").distinct().collect()):  # a number for each 4 MB of benchmark
        held = [(r.item_id, plain(r.text)) for r in numbered.where(F.col("block") == block).orderBy("item_id").collect()]
        sent = docs.sparkSession.sparkContext.broadcast([x for x in held if len(x[1]) >= LEAST_CHARS])

        udf = searcher(sent, rate)
        found = found.withColumn("_items", F.concat("_items", udf("_row.text")))
    return found.withColumn("_items", F.array_sort("_items"))


def contaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, contaminated, items, edits) for every row: the items in its text, and the edits of each.

    An item_id that stands for several texts is listed once, with its least edits.
    """
    once = "filter(_items, (x, i) -> i = 0 or get(_items, i - 1).item_id != x.item_id)"
    return hits(docs.select("doc_id", "text"), items, rate).withColumn("_items", F.expr(once)).select(
        "_row.doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_items.item_id").alias("items"), F.col("_items.edits").alias("edits"))


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """`docs` without the rows whose text holds a benchmark item."""
    return hits(docs, items, rate).where(F.size("_items") == 0).select("_row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
