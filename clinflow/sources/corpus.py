"""Knowledge documents from Q&A tables, JSON collections and web pages."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.functions.text import fixed_chunks, is_blank, strip
from clinflow.functions.batched import boundary_chunks

DOCUMENT = "content STRING, disease STRING, source STRING, meta MAP<STRING,STRING>"
JSON_RECORD = (
    "title STRING, question STRING, answer STRING, content STRING, decision STRING, pubid STRING, "
    "source STRING, url STRING, disease STRING"
)
TITLE_LENGTH = 120
MIN_PAGE_TEXT = 100


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def _column_like(table: DataFrame, *parts: str) -> str | None:
    return next((name for name in table.columns if any(part in name for part in parts)), None)


def qa_documents(table: DataFrame, source: str = "MedQuAD") -> DataFrame:
    """Documents of a question/answer table, columns found by parts of their names.

    A missing question is an empty text here.
    """
    table = table.toDF(*[name.strip().lower() for name in table.columns])
    ask, reply = _column_like(table, "question"), _column_like(table, "answer")
    topic = _column_like(table, "disease", "focus")
    text = lambda name, other: strip(F.coalesce(F.col(name).cast("string"), F.lit(other))) if name else F.lit(other)
    question, answer, disease = text(ask, ""), text(reply, ""), text(topic, "" if topic else "General")
    return table.filter(~is_blank(F.col(reply).cast("string"))).select(
        F.concat(F.lit("Disease: "), disease, F.lit("\nQuestion: "), question, F.lit("\nAnswer: "), answer).alias("content"),
        disease.alias("disease"), F.lit(source).alias("source"), F.create_map(F.lit("question"), question).alias("meta"),
    )


def read_json_records(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """Records of a collection; a missing path gives no records.

    `form` is "lines" (JSON lines, cut into splits) or "parquet" for large collections; "array" reads files that
    hold one JSON array each, a task for each file.
    """
    reader = spark.read.schema(JSON_RECORD)
    try:
        return reader.parquet(path) if form == "parquet" else reader.json(path, multiLine=form == "array")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], JSON_RECORD)


def record_documents(records: DataFrame, source: str, disease: Column, meta: str | None = None) -> DataFrame:
    """Records to documents, all but those with a blank content."""
    kept = records.filter(~is_blank("content"))
    extra = F.create_map(F.lit(meta), F.coalesce(F.col(meta), F.lit(""))) if meta else F.create_map().cast("map<string,string>")
    return kept.select(strip("content").alias("content"), disease.alias("disease"), F.lit(source).alias("source"), extra.alias("meta"))


def article_documents(records: DataFrame) -> DataFrame:
    """Articles; the disease is the start of the title."""
    title = F.substring(F.coalesce("title", F.lit("General")), 1, TITLE_LENGTH)
    return record_documents(records, "PubMedQA", title, "pubid")


def factsheet_documents(records: DataFrame) -> DataFrame:
    """Fact sheets."""
    return record_documents(records, "WHO Fact Sheets", F.coalesce("title", F.lit("General")), "url")


def flashcard_documents(records: DataFrame) -> DataFrame:
    """Flashcards."""
    return record_documents(records, "HF-MedFlashcards", F.coalesce("disease", F.lit("General Medical")))


def article_records(rows: DataFrame) -> DataFrame:
    """Source articles (context.contexts, a list, or text) to records; incomplete rows drop out."""
    text = lambda name: strip(F.coalesce(F.col(name).cast("string"), F.lit("")))
    kind = rows.schema["context"].dataType.typeName()
    if kind == "string":
        context = text("context")
    else:
        parts = F.col("context.contexts") if kind == "struct" else F.col("context")
        full = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != "")
        context = F.array_join(F.transform(full, strip), " ")
    question, answer, decision = text("question"), text("long_answer"), text("final_decision")
    part = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    return rows.filter((question != "") & (answer != "")).select(
        F.substring(question, 1, TITLE_LENGTH).alias("title"), question.alias("question"), answer.alias("answer"),
        F.concat_ws("\n", part("Question: ", question), part("Abstract: ", context),
                    part("Conclusion: ", answer), part("Decision: ", decision)).alias("content"),
        decision.alias("decision"), F.coalesce(F.col("pubid").cast("string"), F.lit("")).alias("pubid"),
        F.lit("PubMedQA").alias("source"),
    )


def flashcard_records(rows: DataFrame, source: str) -> DataFrame:
    """(instruction, output) cards to records."""
    ask = strip(F.coalesce("instruction", F.lit("")))
    reply = strip(F.coalesce("output", F.lit("")))
    content = F.when(ask == "", reply).otherwise(F.concat(F.lit("Question: "), ask, F.lit("\nAnswer: "), reply))
    return rows.filter(reply != "").select(
        F.lit(source).alias("source"), F.lit("General Medical").alias("disease"), content.alias("content")
    )


#: A start tag as browsers read it: a letter after <, and > only outside quotes ends it.
TAG = r"""</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>"""
ANCHOR = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*>"""
HREF = r"""(?is)^<a(?:\s+(?!href\s*=)[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*\s+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_links(pages: DataFrame, part: str, base: Column | None = None) -> DataFrame:
    """Distinct links whose address contains `part`, resolved against the page or `base`.

    Addresses may be in either kind of quotes or in none; character references are decoded, and the
    steps `.` and `..` of a path are taken.
    """
    held = base if base is not None else F.col("url")
    # Outer: an inner one would be preceded by a filter that searches every page a second time.
    tags = pages.select(held.alias("base"), F.explode_outer(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", HREF, group) for group in (1, 2, 3)])
    found = tags.filter(F.rlike("tag", F.lit(HREF))).select("base", strip(decode_entities(href)).alias("href")).distinct()
    return found.filter(F.contains("href", F.lit(part))).select(joined_url(F.col("base"), F.col("href")).alias("link")).distinct()


def joined_url(base: Column, href: Column) -> Column:
    """The address that a reference on a page means (RFC 3986)."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
    return (
        F.when(F.rlike(href, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(href == "", F.concat(origin, path, query))
        .when(own == "", F.concat(origin, path, F.when(F.startswith(rest, F.lit("#")), query).otherwise(F.lit("")), rest))
        .otherwise(F.concat(origin, without_dots(whole), rest))
    )


def without_dots(path: Column) -> Column:
    """A path from / with its `.` and `..` steps taken."""
    steps = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    none = F.array().cast("array<string>")

    def taken(held: Column, step: Column) -> Column:
        up = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when(step == "..", up).when(step == ".", held).otherwise(F.concat(held, F.array(step)))

    folder = F.rlike(path, F.lit(r"/\.\.?$"))
    walked = F.array_join(F.aggregate(steps, none, taken), "/")
    return F.concat(F.lit("/"), walked, F.when(folder & (walked != ""), F.lit("/")).otherwise(F.lit("")))


def decode_entities(text: Column) -> Column:
    """Character references of a text as their characters: all names of HTML, decimal and hexadecimal numbers.

    A reference is decoded once; an unknown name, or one without its semicolon, stays.
    """
    names = F.from_json(F.lit(json.dumps({name[:-1]: sign for name, sign in html5.items() if name.endswith(";")})), "map<string,string>")
    pieces = F.split(text, r"(?=&#?[a-zA-Z0-9]{1,32};)")

    def shown(piece: Column) -> Column:
        held = F.regexp_extract(piece, r"(?s)^&(#?[a-zA-Z0-9]{1,32});", 1)
        after = F.substr(piece, F.length(held) + 3)
        number = F.when(
            F.rlike(held, F.lit("^#[0-9]{1,7}$")), F.substr(held, F.lit(2)).cast("int")
        ).when(F.rlike(held, F.lit("^#[xX][0-9a-fA-F]{1,6}$")), F.conv(F.substr(held, F.lit(3)), 16, 10).cast("int"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.try_element_at(names, held))
        return F.when((held == "") | sign.isNull(), piece).otherwise(F.concat(sign, after))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, shown), "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, blanks collapsed.

    A `<` that no letter follows is text.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<![a-zA-Z][^>]*>", " ")
    plain = decode_entities(F.regexp_replace(bare, TAG, " "))
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def page_records(pages: DataFrame, source: str = "WHO Fact Sheets") -> DataFrame:
    """Pages to records; pages with hardly any text drop out. The title comes from the address."""
    slug = F.element_at(F.split(F.rtrim(F.col("url"), F.lit("/")), "/"), -1)
    out = pages.select(
        F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))).alias("title"), "url", F.lit(source).alias("source"),
        visible_text(F.col("html")).alias("content"),
    )
    return out.filter(F.length("content") >= MIN_PAGE_TEXT)


def union_corpus(*parts: DataFrame) -> DataFrame:
    """All parts one after another, without removing repeats; missing columns become null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def union_readable(readers) -> DataFrame:
    """Union of the parts that are there; a part whose path doesn't exist is left out."""
    parts = []
    for read in readers:
        try:
            parts.append(read())
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not parts:
        raise ValueError("no part of the corpus could be read")
    return union_corpus(*parts)


def chunk_lists(size: int = 500, overlap: int = 50, boundaries: bool = False) -> Column:
    """F18 inside the row: the chunks of `content` as an array, for what needs a document's chunks together."""
    return boundary_chunks(size, overlap)("content") if boundaries else fixed_chunks("content", size, overlap)


def chunk_documents(documents: DataFrame, size: int = 500, overlap: int = 50, boundaries: bool = False) -> DataFrame:
    """one row per chunk, with `chunk_no`; whole texts, other columns repeated."""
    kept = [name for name in documents.columns if name != "content"]
    chunks = documents.select(*kept, F.posexplode_outer(chunk_lists(size, overlap, boundaries)).alias("chunk_no", "content"))
    return chunks.filter(F.col("chunk_no").isNotNull())
