"""Conversation memory and triage routes over message tables.

Messages: user_id, seq (0, 1, 2 … per user without gaps), role (human or ai), content, ts.
`joining.numbered` makes such a `seq` where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions import language as lang
from clinflow.functions import triage
from clinflow.functions.text import context_snippet, is_blank
from clinflow.lookups.triage import REPLIES, SYSTEM_TEXTS
from clinflow.operators.containment import longest_name
from clinflow.operators.joining import framed, lookup_join, top_rows

HISTORY = 20
HISTORY_HOURS = 24
PROMPT_TURNS = 4
CARRY_TURNS = 10


def recent_memory(messages: DataFrame, as_of: Column, top: int = HISTORY, hours: int = HISTORY_HOURS) -> DataFrame:
    """E5: newest messages per user; nothing of a user whose last message is older than the limit."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    kept = top_rows(messages, ["user_id"], [F.desc("seq")], top, "rank")
    # Each save renews the whole list, so the newest message of the user decides.
    alive = messages.groupBy("user_id").agg(F.max("ts").alias("_last")).filter(F.col("_last") >= since).select("user_id")
    return kept.join(alive, "user_id", "left_semi")


def since_reset(messages: DataFrame) -> DataFrame:
    """Messages after the user's last reset marker (`is_reset`), markers left out."""
    resets = messages.filter("is_reset").groupBy("user_id").agg(F.max("seq").alias("_reset"))
    # One row per user on the right: adaptive execution splits the messages of a hot user.
    joined = messages.filter(~F.col("is_reset")).join(resets, "user_id", "left")
    return joined.filter(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")


def prompt_frames(messages: DataFrame, documents: str | None = None, back: int = PROMPT_TURNS) -> DataFrame:
    """Per human message the list of (role, content) to send to a model.

    System text by language, up to two document snippets, the messages before, the message.
    `documents` names an array column of texts, if there is one.
    """
    role = F.when(F.col("role") == "human", "user").otherwise("assistant")
    entry = F.struct(role.alias("role"), F.col("content").alias("content"))
    held = framed(
        messages.withColumn("_entry", entry), "user_id", "seq", back,
        {"_before": lambda w: F.collect_list("_entry").over(w)},
    ).filter(F.col("role") == "human")

    def said(role_name: str, text: Column) -> Column:
        return F.array(F.struct(F.lit(role_name).alias("role"), text.alias("content")))

    language = lang.detect_language(F.col("content"))
    system = F.try_element_at(F.create_map(*[F.lit(x) for pair in SYSTEM_TEXTS.items() for x in pair]), language)
    parts = [said("system", system)]
    if documents:
        cut = F.transform(F.slice(documents, 1, 2), lambda d: F.substring(d, 1, 300))
        none = F.array().cast("array<struct<role:string,content:string>>")
        parts.append(F.when(F.size(documents) > 0, said("system", F.array_join(cut, "\n\n"))).otherwise(none))
    parts += [F.col("_before"), said("user", F.col("content"))]
    return held.select("user_id", "seq", F.concat(*parts).alias("messages"))


def carried_disease(messages: DataFrame, names: DataFrame, back: int = CARRY_TURNS, text: str = "content") -> DataFrame:
    """Adds `carried`, the disease the assistant named last in the messages before.

    `names` has (disease); the message's own disease is in `mentioned`. `text` is the column to look in.
    """
    named = longest_name(messages, names, text, "disease", "mentioned")
    said = F.when(F.col("role") == "ai", F.col("mentioned"))
    return framed(
        named.withColumn("_said", said), "user_id", "seq", back,
        {"carried": lambda w: F.last("_said", ignorenulls=True).over(w)},
    ).drop("_said")


def document_disease(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `from_documents`, the disease named by the first of `documents` that names one.

    Only messages that name none themselves, and carry none, are looked at.
    """
    open_rows = messages.filter(F.col("mentioned").isNull() & F.col("carried").isNull())
    texts = open_rows.select(F.struct("user_id", "seq").alias("_key"), F.posexplode("documents").alias("_at", "_text"))
    named = longest_name(texts, names, "_text", "disease", "_name")
    found = named.filter(F.col("_name").isNotNull()).groupBy("_key").agg(F.min_by("_name", "_at").alias("from_documents"))
    return messages.join(found.select("_key.user_id", "_key.seq", "from_documents"), ["user_id", "seq"], "left")


def in_english(messages: DataFrame, supplied: str | None = None) -> DataFrame:
    """Adds `language` and `english`, the message in English; `supplied` names a column of translations, null where none."""
    rows = messages.withColumn("language", lang.detect_language(F.col("content")))
    given = F.col(supplied) if supplied else None
    return rows.withColumn("english", lang.translate_to_english(F.col("content"), F.col("language"), given))


def triage_routes(messages: DataFrame, guidance: DataFrame, medicines: DataFrame) -> DataFrame:
    """F16: route and reply of each message.

    Takes message rows with `carried` and `mentioned` (from `carried_disease`), `documents`, an array
    of texts, best first, and `from_documents` (from `document_disease`). `guidance` has (keyword,
    guidance), `medicines` has (disease, otc, rx).
    """
    content = F.col("content")
    rows = messages.withColumn("language", lang.detect_language(content))
    rows = rows.withColumn("english", lang.translate_to_english(content, F.col("language")))
    english = F.col("english")
    greeting = F.coalesce(
        triage.greeting_kind(content, F.col("language")), triage.greeting_kind(english, F.col("language"))
    )
    rows = rows.withColumn("disease", F.coalesce("mentioned", "carried", "from_documents"))
    rows = rows.withColumn("keyword", triage.first_keyword(english)).withColumn("greeting", greeting)
    has_documents = F.size("documents") > 0
    route = (
        F.when(F.col("greeting").isNotNull(), F.lit("greeting"))
        .when(triage.is_emergency(english), F.lit("emergency"))
        .when(triage.asks_for_medicine(english) & F.col("disease").isNotNull(), F.lit("medicine"))
        .when(triage.asks_for_medicine(english), F.lit("ask_disease"))
        .when(F.col("keyword").isNotNull(), F.lit("keyword"))
        .when(has_documents, F.lit("retrieved"))
        .otherwise(F.lit("generic"))
    )
    rows = rows.withColumn("route", route)
    spread = ["user_id", "seq"]
    rows = lookup_join(rows, guidance.select("keyword", "guidance"), ["keyword"], spread=spread)
    rows = lookup_join(rows, medicines.select("disease", "otc", "rx"), ["disease"], spread=spread)
    replies = F.create_map(*[F.lit(x) for pair in REPLIES.items() for x in pair])
    text = F.get("documents", F.lit(0))
    by_route = {
        "greeting": F.try_element_at(replies, F.col("greeting")),
        "emergency": F.lit(REPLIES["emergency"]),
        "medicine": triage.medicine_card(F.col("disease"), F.coalesce("otc", F.array().cast("array<string>")),
                                         F.coalesce("rx", F.array().cast("array<string>"))),
        "ask_disease": F.lit(REPLIES["ask_disease"]),
        "keyword": F.concat_ws("\n\n", F.concat(F.initcap("keyword"), F.lit(" guidance:\n"), F.col("guidance")),
                               F.when(has_documents, F.concat(F.substring(text, 1, 300), F.lit("..."))),
                               F.lit(REPLIES["notice"])),
        "retrieved": F.concat_ws("\n\n", F.substring(text, 1, 400), F.lit(REPLIES["notice"])),
        "generic": F.concat_ws("\n\n", F.lit(REPLIES["generic"]), F.lit(REPLIES["notice"])),
    }
    reply = F.lit(None).cast("string")
    for name, value in by_route.items():
        reply = F.when(F.col("route") == name, value).otherwise(reply)
    return rows.select("user_id", "seq", "language", "english", "route", "disease", "keyword", reply.alias("reply"))


def clean_documents(texts: Column) -> Column:
    """P7 on an array of texts: blank ones out, printable characters only, 300 characters each."""
    kept = F.filter(texts, lambda d: ~is_blank(d))
    return F.transform(kept, lambda d: context_snippet(d))


def language_mismatch(pairs: DataFrame) -> DataFrame:
    """F11 as a report over (question, reply): verdict counts and share per question language."""
    asked = lang.detect_language(F.col("question"))
    judged = pairs.select(asked.alias("language"), lang.reply_verdict(asked, F.col("reply")).alias("verdict"))
    return judged.groupBy("language").agg(
        F.count("*").alias("replies"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("keep", "romanise", "translate")],
    )
