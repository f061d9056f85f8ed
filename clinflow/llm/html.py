"""Main text of web pages by container paths that the pages of a host agree on."""

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clinflow.llm.common import BROADCAST_BYTES, bound_batches, table
from clinflow.session import send_by_value, written

send_by_value(__name__)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
#: Elements that are never part of the main text.
SKIPPED = frozenset("head nav footer aside form button select dialog menu object audio video canvas map".split()) | RAW
#: Words of class, id or role that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo cookie cookies consent notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related "
    "recommended recommendations comment comments commentlist disqus replies reply respond pagination pager toolbar widget hidden".split())
HEADS = frozenset(("header", "masthead"))
COMMENTS = frozenset(("comment", "comments", "commentlist", "replies", "reply"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that hold other blocks and can be the container of a main text.
CONTAINERS = frozenset("article body center div main section table tbody td tr blockquote fieldset".split())
#: An open element of the second set ends when one of the first begins.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
FAR = 0.8
SEMANTIC = 1.5
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def text_blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of the text blocks of a page that aren't skipped, in page order.

    The path goes from the body to the innermost container, as tags with their classes, in which digits are
    generalised. White space inside a block is one space; character references are decoded.
    """
    found: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path, skipped
    texts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            found.append((stack[-1][1] if stack else "", text, linked))
        texts.clear()
        linked = 0

    def close(at: int) -> None:
        """Ends the open elements from place `at` on."""
        nonlocal links
        while len(stack) > at:
            tag = stack[-1][0]
            if tag in BLOCKS:
                flush()
            links -= tag == "a"
            stack.pop()

    position, end = 0, len(page)
    while position < end:
        match = TOKEN.match(page, position)
        position = match.end()
        tag = match[2]
        if tag is None:
            piece = match[0]
            if not piece.startswith(("<!", "<?")) and not (stack and stack[-1][2]):
                piece = html.unescape(piece)
                texts.append(piece)
                linked += len(piece) * (links > 0)
            continue
        tag = tag.lower()
        open_at = lambda names: next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in names), None)
        if match[1]:
            at = open_at((tag,))
            if at is not None:
                close(at)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            texts.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            position = stop.end() if stop else end
            continue
        if tag in ENDED:
            at = open_at(ENDED[tag] | {"ul", "ol", "dl", "table", "article", "div", "section"})
            if at is not None and stack[at][0] in ENDED[tag]:
                close(at)
        if tag in BLOCKS:
            at = open_at(("p", "article", "div", "section", "td", "th", "li", "body"))
            if at is not None and stack[at][0] == "p":
                close(at)
            flush()
        path, skipped = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        marks = attributes(match[3]) if "=" in match[3] else {}
        classes = marks.get("class", "").lower().split()
        named = f"{marks.get('class', '')} {marks.get('id', '')} {marks.get('role', '')}".lower()
        within = "article" in path or "main" in path
        said = set(WORDS.findall(named)) & MARKS
        if within:
            said -= HEADS
        if tag in ("html", "body", "article", "main"):  # may be named for what they hold, but a comment can be an article
            said &= COMMENTS
        skipped = skipped or tag in SKIPPED or (tag == "header" and not within) or bool(said) or marks.get("aria-hidden") == "true"
        if tag in CONTAINERS:
            path = f"{path}/{'.'.join([tag, *(DIGITS.sub('#', c) for c in sorted(classes))])}"
        if not match[3].endswith("/") or tag in BLOCKS:
            stack.append((tag, path, skipped))
            links += tag == "a"
    close(0)
    flush()
    return found


def container_scores(blocks: list[tuple[str, str, int]]) -> dict[str, float]:
    """The score of each container path: its characters outside links, less for each level they lie deeper."""
    scores: dict[str, float] = {}
    for path, text, linked in blocks:
        worth = max(len(text) - 2 * linked, 0)
        while path:
            tag = path.rpartition("/")[2].partition(".")[0]
            scores[path] = scores.get(path, 0) + worth * (SEMANTIC if tag in ("article", "main") else 1)
            path = path.rpartition("/")[0]
            worth *= FAR
    return scores


def best(scores: dict[str, float]) -> str:
    return max(scores, key=lambda path: (scores[path], path), default="")


def main_text(blocks: list[tuple[str, str, int]], votes: dict[str, int]) -> str:
    """The blocks in the container path with the most votes of those the page has, joined by line feeds."""
    scores = container_scores(blocks)
    chosen = max(scores, key=lambda path: (votes.get(path, 0), scores[path], path), default="")
    return "\n".join(text for path, text, _ in blocks if path == chosen or path.startswith(chosen + "/"))


@F.pandas_udf(StringType())
def page_text(pages: pd.Series, paths: pd.Series, votes: pd.Series) -> pd.Series:
    known = (dict(zip(p, v)) if p is not None else {} for p, v in zip(paths, votes))
    return pd.Series([main_text(text_blocks(page), held) for page, held in zip(pages, known)], dtype=object)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.withColumn("_host", F.lower(F.coalesce(host, F.lit(""))))


def path_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many pages of a host have their best container at a path."""
    bound_batches(pages.sparkSession)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [best(container_scores(text_blocks(page))) for page in batch.html]
            counts = pd.DataFrame({"_host": batch["_host"], "path": paths, "votes": 1}).groupby(["_host", "path"], as_index=False).sum()
            yield counts[counts.path != ""]

    sent = with_host(pages).select("_host", F.coalesce("html", F.lit("")).alias("html"))
    return sent.mapInPandas(vote, "_host string, path string, votes long").groupBy("_host", "path").agg(F.sum("votes").alias("votes"))


def extracted(pages: DataFrame, salts: int = 32) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    Each page scores its containers and votes for the best one's tag-class path; votes are counted per
    host; then every page is extracted again at the path with most votes among those it has. Menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out
    by element and by the words of class, id and role. Ties go to the page's own higher score.

    The votes of a host come to its pages by a join: broadcast when their bytes are below a checked
    bound, else with every host's pages salted, so that no host is one task.

    A null or empty page has an empty text, as has a page without containers. A null url belongs to the
    host ''. Rows that repeat are extracted one by one, and vote each. Very long pages are read whole.
    Other columns are not read.
    """
    votes = written(path_votes(pages), "path-votes")
    size = votes.agg(F.sum(F.length("_host") + F.length("path") + 32)).first()[0] or 0
    hosts = votes.groupBy("_host").agg(F.collect_list("path").alias("paths"), F.collect_list("votes").alias("votes"))
    sent = with_host(pages).select("page_id", "url", "_host", F.coalesce("html", F.lit("")).alias("html"))
    if size <= BROADCAST_BYTES:
        joined = sent.join(F.broadcast(hosts), "_host", "left")
    else:
        copies = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = sent.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        joined = salted.join(copies, ["_host", "_salt"], "left")
    return joined.select("page_id", "url", page_text("html", "paths", "votes").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
