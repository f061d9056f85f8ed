"""Messages: language rules, triage rules, memory and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from clinflow.functions import language as lang
from clinflow.functions import text, triage
from clinflow.lookups import language as words
from clinflow.lookups import seeds, tables as lookups
from clinflow.lookups import triage as rules
from clinflow.operators import chat, cleanse
from clinflow.operators.containment import longest_name
from clinflow.operators.medicines import tier_lists
from clinflow.plans.triage import triage_messages

QUERIES, ORACLES = {}, {}
KEY = ["user_id", "seq"]


def query(name, sql=None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def nested_replace(start: str, pairs) -> str:
    for old, new in pairs:
        start = f"replace({start}, {b.text(old)}, {b.text(new)})"
    return start


def language_sql(column: str) -> str:
    tokens = f"string_split_regex(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+')"
    return f"""CASE WHEN trim({column}, {b.WHITE}) = '' THEN 'english' WHEN regexp_matches({column}, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'urdu'
    WHEN len(list_intersect({tokens}, {b.text(words.ROMAN_URDU_HINTS)})) >= 2 OR list_has_any({tokens}, {b.text(words.STRONG_HINTS)}) THEN 'roman_urdu'
    ELSE 'english' END"""


PHRASES_SQL = lambda column: nested_replace(f"lower({column})", sorted(words.PHRASES.items(), key=lambda p: -len(p[0])))
LANG_SQL = b.MESSAGES_SQL + f", spoken AS (SELECT *, {language_sql('content')} AS language FROM messages)"
ENGLISH_SQL = LANG_SQL + f", english AS (SELECT *, CASE WHEN language = 'roman_urdu' THEN {PHRASES_SQL('content')} ELSE content END AS english FROM spoken)"


def spoken(spark, sf):
    return b.messages(spark, sf).withColumn("language", lang.detect_language(F.col("content")))


@query("f4_language_detection", f"WITH {LANG_SQL} SELECT user_id, seq, language FROM spoken")
def f4(spark, sf):
    return spoken(spark, sf).select(*KEY, "language")


@query("f4_language_of_documents", f"SELECT doc_id, {language_sql('text')} AS language FROM documents")
def f4_documents(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", lang.detect_language(F.col("text")).alias("language"))


@query("f5_phrase_translation", f"WITH {b.MESSAGES_SQL} SELECT user_id, seq, {PHRASES_SQL('content')} AS english FROM messages")
def f5(spark, sf):
    return b.messages(spark, sf).select(*KEY, lang.translate_phrases(F.col("content")).alias("english"))


@query("f6_wording_normalise", f"WITH {b.MESSAGES_SQL} SELECT user_id, seq, {nested_replace('lower(content)', words.TERM_SYNONYMS.items())} AS wording FROM messages")
def f6(spark, sf):
    return b.messages(spark, sf).select(*KEY, lang.normalise_wording(F.col("content")).alias("wording"))


@query("f7_translation_route", f"WITH {ENGLISH_SQL} SELECT user_id, seq, language, english, language = 'urdu' AS needs_translation FROM english")
def f7(spark, sf):
    return spoken(spark, sf).select(
        *KEY, "language", lang.translate_to_english(F.col("content"), F.col("language")).alias("english"),
        lang.needs_translation(F.col("language")).alias("needs_translation"),
    )


ROMAN_SQL = f"""trim(regexp_replace(regexp_replace({nested_replace('content', [words.LETTER_PAIR, *words.LETTERS.items()])},
  '[^\\x00-\\x7F]', '', 'g'), ' {{2,}}', ' ', 'g'), {b.WHITE})"""


@query("f8_romanise", f"WITH {b.MESSAGES_SQL} SELECT user_id, seq, {ROMAN_SQL} AS latin FROM messages")
def f8(spark, sf):
    return b.messages(spark, sf).select(*KEY, lang.romanise(F.col("content")).alias("latin"))


def cleaned_sql(column: str) -> str:
    for pattern, word in words.REPLY_TERMS:
        column = f"regexp_replace({column}, {b.text('(?i)' + pattern)}, {b.text(word)}, 'g')"
    return f"regexp_replace({column}, ' {{2,}}', ' ', 'g')"


@query("f9_reply_terms", f"WITH {b.MESSAGES_SQL} SELECT user_id, seq, {cleaned_sql('content')} AS reply FROM messages")
def f9(spark, sf):
    return b.messages(spark, sf).select(*KEY, lang.clean_reply_terms(F.col("content")).alias("reply"))


ENGLISH_TEST = lambda column, language: f"""({language} = 'english' AND CASE WHEN length(regexp_replace({column}, '\\P{{L}}', '', 'g')) = 0 THEN true
  ELSE length(regexp_replace({column}, '[^A-Za-z]', '', 'g'))::DOUBLE / length(regexp_replace({column}, '\\P{{L}}', '', 'g')) > 0.85::DOUBLE END)"""  # noqa: E731


@query("f10_english_check", f"WITH {LANG_SQL} SELECT user_id, seq, {ENGLISH_TEST('content', 'language')} AS english FROM spoken")
def f10(spark, sf):
    return spoken(spark, sf).select(*KEY, lang.is_english(F.col("content"), F.col("language")).alias("english"))


MISMATCH_SQL = f"""WITH {LANG_SQL}, pairs AS (
  SELECT h.language AS asked, a.content AS reply, a.language AS answered FROM spoken h JOIN spoken a
  ON a.user_id = h.user_id AND a.seq = h.seq + 1 AND a.role = 'ai' AND h.role = 'human'),
judged AS (SELECT asked, CASE WHEN asked = 'english' OR reply = '' OR asked = answered THEN 'keep'
  WHEN asked = 'roman_urdu' AND answered = 'urdu' THEN 'romanise' WHEN {ENGLISH_TEST('reply', 'answered')} THEN 'translate' ELSE 'keep' END AS v FROM pairs)
SELECT asked AS language, count(*) AS replies, count(*) FILTER (v = 'keep') AS keep, count(*) FILTER (v = 'romanise') AS romanise,
  count(*) FILTER (v = 'translate') AS translate FROM judged GROUP BY 1"""


@query("f11_reply_language", MISMATCH_SQL)
def f11(spark, sf):
    rows = b.messages(spark, sf)
    asked = rows.filter("role = 'human'").select("user_id", (F.col("seq") + 1).alias("seq"), F.col("content").alias("question"))
    said = rows.filter("role = 'ai'").select("user_id", "seq", F.col("content").alias("reply"))
    return chat.language_mismatch(asked.join(said, KEY))


CORE = f"rtrim(lower(trim(content, {b.WHITE})), '!?., ')"
GREETING_SQL = f"""(list_contains({b.text(rules.GREETINGS + rules.OPEN_GREETINGS)}, {CORE}) OR
  len(list_filter({b.text(rules.OPEN_GREETINGS)}, lambda g: starts_with({CORE}, g || ' ') OR ends_with({CORE}, ' ' || g))) > 0)"""


@query("f12_greeting", f"""WITH {LANG_SQL} SELECT user_id, seq, CASE WHEN {GREETING_SQL} THEN 'greeting_' || language END AS kind FROM spoken""")
def f12(spark, sf):
    return spoken(spark, sf).select(*KEY, triage.greeting_kind(F.col("content"), F.col("language")).alias("kind"))


def groups_sql(present: str) -> str:
    return "(" + " OR ".join(f"list_has_all({present}, {b.text(group)})" for group in rules.EMERGENCY_GROUPS) + ")"


SPACED = "replace(lower(content), '_', ' ')"
PRESENT = f"list_filter({b.text(rules.KEYWORDS)}, lambda k: contains({SPACED}, k))"
ALL_WORDS = sorted({word for group in rules.EMERGENCY_GROUPS for word in group})
PRESENT_ALL = f"list_filter({b.text(ALL_WORDS)}, lambda k: contains({SPACED}, k))"


@query("f13_emergency", f"""WITH {b.MESSAGES_SQL} SELECT user_id, seq, array_to_string({PRESENT}, '|') AS present,
  {groups_sql(PRESENT)} AS emergency, {groups_sql(PRESENT_ALL)} AS all_words FROM messages""")
def f13(spark, sf):
    content = F.col("content")
    return b.messages(spark, sf).select(
        *KEY, b.bar(triage.present_keywords(content)).alias("present"), triage.is_emergency(content).alias("emergency"),
        triage.is_emergency_all_words(content).alias("all_words"),
    )


MEDICINE_SQL = f"len(list_filter({b.text(rules.MEDICINE_WORDS)}, lambda k: contains(lower(content), k))) > 0"
KEYWORD_SQL = f"list_filter({b.text(rules.KEYWORDS)}, lambda k: contains({SPACED}, k) OR contains(lower(content), replace(k, ' ', '_')))[1]"


@query("f14_medicine_question", f"WITH {b.MESSAGES_SQL} SELECT user_id, seq, {MEDICINE_SQL} AS asks FROM messages")
def f14(spark, sf):
    return b.messages(spark, sf).select(*KEY, triage.asks_for_medicine(F.col("content")).alias("asks"))


@query("f15_first_keyword", f"WITH {b.MESSAGES_SQL} SELECT user_id, seq, {KEYWORD_SQL} AS keyword FROM messages")
def f15(spark, sf):
    return b.messages(spark, sf).select(*KEY, triage.first_keyword(F.col("content")).alias("keyword"))


NAMES = [d for d in dict.fromkeys(m[0] for m in seeds.MEDICINES)]
NAMES_SQL = "names AS " + b.values(["disease"], [(n,) for n in NAMES])


def mentioned_sql(column: str) -> str:
    return f"(SELECT disease FROM names WHERE contains(lower({column}), lower(disease)) ORDER BY length(disease) DESC, disease LIMIT 1)"


@query("j9_disease_in_text", f"WITH {b.MESSAGES_SQL}, {NAMES_SQL} SELECT user_id, seq, {mentioned_sql('content')} AS mentioned FROM messages")
def j9(spark, sf):
    rows = b.messages(spark, sf).withColumn("key", F.struct(*KEY))
    return longest_name(rows, lookups.medicines(spark), "content", "disease", "mentioned").select(*KEY, "mentioned")


@query("j9_longest_word_in_documents", """WITH names AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark),
hit AS (SELECT doc_id, w FROM documents, names WHERE w <> '' AND contains(lower(text), lower(w)))
SELECT doc_id, w FROM documents LEFT JOIN (SELECT doc_id, min_by(w, (-length(w), w)) AS w FROM hit GROUP BY 1) USING (doc_id)""")
def j9_documents(spark, sf):
    names = b.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).filter("w <> ''").distinct()
    return longest_name(b.table(spark, sf, "documents"), names, "text", "w", "w").select("doc_id", "w")


CARRIED_SQL = ENGLISH_SQL + f""", {NAMES_SQL}, named AS (SELECT *, {mentioned_sql('content')} AS mentioned FROM english),
carried AS (SELECT *, last(CASE WHEN role = 'ai' THEN mentioned END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS carried FROM named)"""


@query("e7_carried_disease", f"WITH {CARRIED_SQL} SELECT user_id, seq, mentioned, carried FROM carried")
def e7(spark, sf):
    return chat.carried_disease(b.messages(spark, sf), lookups.medicines(spark)).select(*KEY, "mentioned", "carried")


MEMORY_AS_OF = "2024-01-02 00:30:00"


@query("e5_recent_memory", f"""WITH {b.MESSAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rank,
  max(ts) OVER (PARTITION BY user_id) AS last_ts FROM messages)
SELECT user_id, seq, content, rank FROM r WHERE rank <= 4 AND last_ts >= TIMESTAMP '{MEMORY_AS_OF}' - INTERVAL 24 HOUR""")
def e5(spark, sf):
    rows = chat.recent_memory(b.messages(spark, sf), F.expr(f"TIMESTAMP_NTZ '{MEMORY_AS_OF}'"), top=4)
    return rows.select(*KEY, "content", "rank")


SYSTEM = "MAP {" + ", ".join(f"{b.text(k)}: {b.text(v)}" for k, v in rules.SYSTEM_TEXTS.items()) + "}"


@query("e6_prompt_frames", f"""WITH {LANG_SQL}, framed AS (SELECT *, list({{'r': CASE WHEN role = 'human' THEN 'user' ELSE 'assistant' END, 'c': content}})
  OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before FROM spoken)
SELECT user_id, seq, array_to_string(list_concat(['system:' || {SYSTEM}[language]],
  list_transform(coalesce(before, []), lambda m: m.r || ':' || m.c), ['user:' || content]), '|') AS messages FROM framed WHERE role = 'human'""")
def e6(spark, sf):
    rows = chat.prompt_frames(b.messages(spark, sf))
    return rows.withColumn("messages", b.bar(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))))


@query("e12_since_reset", f"""WITH {b.MESSAGES_SQL}, r AS (SELECT *, max(seq) FILTER (is_reset) OVER (PARTITION BY user_id) AS cut FROM messages)
SELECT user_id, seq, role, content FROM r WHERE NOT is_reset AND (cut IS NULL OR seq > cut)""")
def e12(spark, sf):
    return chat.since_reset(b.messages(spark, sf)).select(*KEY, "role", "content")


@query("p4_message_validation", f"""WITH {b.MESSAGES_SQL}, t AS (SELECT user_id, seq, trim(CASE WHEN seq = 5 THEN '  ' ELSE content END, {b.WHITE}) AS content FROM messages)
SELECT user_id, seq, content, CASE WHEN content = '' THEN 'empty' WHEN length(content) > 1000 THEN 'too long' END AS reason FROM t""")
def p4(spark, sf):
    rows = b.messages(spark, sf).withColumn("content", F.when(F.col("seq") == 5, "  ").otherwise(F.col("content")))
    return cleanse.validate_messages(rows).select(*KEY, "content", "reason")


def cards_sql(otc: str, rx: str) -> str:
    lines = lambda items: f"array_to_string(list_transform({items}, lambda m: '  • ' || m), chr(10))"
    return f"""array_to_string(list_filter(['Recommended medications for ' || disease || ':' || chr(10),
    CASE WHEN len({otc}) > 0 THEN 'Over-the-counter:' || chr(10) || {lines(otc)} || chr(10) END,
    CASE WHEN len({rx}) > 0 THEN 'Prescription:' || chr(10) || {lines(rx)} || chr(10) END, {b.text(rules.REPLIES['notice'])}], lambda x: x IS NOT NULL), chr(10))"""


@query("f17_medicine_cards", f"""WITH {b.DRUGS_SQL}, l AS (SELECT disease, coalesce(list(drug_name ORDER BY pos) FILTER (drug_type = 'otc'), []) AS otc,
  coalesce(list(drug_name ORDER BY pos) FILTER (drug_type = 'prescription'), []) AS rx FROM (SELECT disease, drug_name, drug_type, min(pos) AS pos FROM drugs GROUP BY ALL) GROUP BY 1)
SELECT disease, {cards_sql('otc', 'rx')} AS card FROM l""")
def f17(spark, sf):
    lists = tier_lists(b.drugs(spark, sf), "pos")
    return lists.select("disease", triage.medicine_card(F.col("disease"), F.col("otc"), F.col("rx")).alias("card"))


GUIDE_SQL = "guide AS " + b.values(["keyword", "guidance"], rules.GUIDANCE.items())
REPLY_MAP = "MAP {" + ", ".join(f"{b.text(k)}: {b.text(v)}" for k, v in rules.REPLIES.items()) + "}"
DOC_SQL = "CASE WHEN doc_id % 4 = 0 THEN 'About Pneumonia. ' || text ELSE text END"
ON_ENGLISH = lambda sql: sql.replace("content", "english")
READ_SQL = CARRIED_SQL.replace(mentioned_sql("content"), mentioned_sql("CASE WHEN role = 'human' THEN english ELSE content END"))
TRIAGE_SQL = READ_SQL + f""", {GUIDE_SQL}, {b.SEED_DRUGS_SQL}, lists AS (SELECT disease, coalesce(list(drug_name ORDER BY pos) FILTER (drug_type = 'otc'), []) AS otc,
  coalesce(list(drug_name ORDER BY pos) FILTER (drug_type = 'prescription'), []) AS rx FROM seed_drugs GROUP BY 1),
docs AS (SELECT doc_id, left(regexp_replace({DOC_SQL}, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g'), 300) AS doc
  FROM documents WHERE trim({DOC_SQL}, {b.WHITE}) <> ''),
judged AS (SELECT user_id, seq, language, english, coalesce(mentioned, carried, {mentioned_sql('doc')}) AS disease, {ON_ENGLISH(KEYWORD_SQL)} AS keyword,
  CASE WHEN {GREETING_SQL} OR {ON_ENGLISH(GREETING_SQL)} THEN 'greeting_' || language END AS greeting,
  {groups_sql(ON_ENGLISH(PRESENT))} AS emergency, {ON_ENGLISH(MEDICINE_SQL)} AS asks, doc
  FROM carried LEFT JOIN docs ON doc_id = user_id * 10 + seq WHERE role = 'human'),
routed AS (SELECT *, CASE WHEN greeting IS NOT NULL THEN 'greeting' WHEN emergency THEN 'emergency' WHEN asks AND disease IS NOT NULL THEN 'medicine'
  WHEN asks THEN 'ask_disease' WHEN keyword IS NOT NULL THEN 'keyword' WHEN doc IS NOT NULL THEN 'retrieved' ELSE 'generic' END AS route FROM judged),
cards AS (SELECT disease, {cards_sql('otc', 'rx')} AS card FROM lists)
SELECT user_id, seq, language, english, route, disease, keyword, CASE route WHEN 'greeting' THEN {REPLY_MAP}[greeting] WHEN 'emergency' THEN {REPLY_MAP}['emergency']
  WHEN 'medicine' THEN card WHEN 'ask_disease' THEN {REPLY_MAP}['ask_disease']
  WHEN 'keyword' THEN array_to_string(list_filter([array_to_string(list_transform(string_split(keyword, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' guidance:' || chr(10) || guidance,
    left(doc, 300) || '...', {REPLY_MAP}['notice']], lambda x: x IS NOT NULL), chr(10) || chr(10))
  WHEN 'retrieved' THEN left(doc, 400) || chr(10) || chr(10) || {REPLY_MAP}['notice']
  ELSE {REPLY_MAP}['generic'] || chr(10) || chr(10) || {REPLY_MAP}['notice'] END AS reply
FROM routed LEFT JOIN guide USING (keyword) LEFT JOIN cards USING (disease)"""


@query("f16_triage_routes", f"WITH {TRIAGE_SQL}")
def f16(spark, sf):
    documents = b.table(spark, sf, "documents").selectExpr("doc_id", f"{DOC_SQL} AS doc")
    rows = b.messages(spark, sf).withColumn("doc_id", F.col("user_id") * 10 + F.col("seq")).join(documents, "doc_id", "left")
    held = F.filter(F.array("doc"), lambda d: d.isNotNull())
    rows = rows.withColumn("documents", chat.clean_documents(held)).drop("doc", "doc_id")
    return triage_messages(rows, lookups.guidance(spark), tier_lists(lookups.medicines(spark), "pos"))


@query("p5_markup_strip", f"SELECT page_id, trim(regexp_replace(url, '<[^>]+>', '', 'g'), {b.WHITE}) AS url, trim(regexp_replace(html, '<[^>]+>', '', 'g'), {b.WHITE}) AS html FROM pages")
def p5(spark, sf):
    return cleanse.strip_all_markup(b.table(spark, sf, "pages"))


@query("p5_nested_markup", f"SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), {b.WHITE}) AS body, url AS link FROM pages")
def p5_nested(spark, sf):
    nested = b.table(spark, sf, "pages").select("page_id", F.struct(F.array("html").alias("parts"), F.create_map(F.lit("u"), F.col("url")).alias("m")).alias("d"))
    return cleanse.strip_all_markup(nested).select("page_id", F.col("d.parts")[0].alias("body"), F.col("d.m")["u"].alias("link"))


@query("p6_printable_gate", f"""SELECT doc_id, {b.rounded("r", 6)} AS printable_ratio FROM (
  SELECT doc_id, length(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS r FROM documents) WHERE r >= 0.7::DOUBLE""")
def p6(spark, sf):
    rows = b.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return cleanse.printable_gate(rows).select("doc_id", F.round("printable_ratio", 6).alias("printable_ratio"))


@query("p7_context_snippets", f"""SELECT doc_id, left(regexp_replace(text, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g'), 300) AS snippet
FROM documents WHERE trim(text, {b.WHITE}) <> ''""")
def p7(spark, sf):
    rows = b.table(spark, sf, "documents").filter(~text.is_blank("text"))
    return rows.select("doc_id", text.context_snippet("text").alias("snippet"))
