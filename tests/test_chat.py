import datetime as dt

from pyspark.sql import functions as F

from clinflow.functions import language as lang
from clinflow.functions import text, triage
from clinflow.lookups import tables
from clinflow.operators import chat, cleanse
from clinflow.operators.containment import contained_pairs, longest_name, possible
from clinflow.operators.medicines import tier_lists
from clinflow.plans.triage import triage_messages


def one(rows, value, make):
    return rows("t STRING", (value,)).select(make(F.col("t")).alias("x")).first().x


def test_language(rows):
    cases = {
        "I have fever and cough": "english", "I'm suffering from a severe headache with sore eyes": "english",
        "mujhe bukhar aur sar dard hai": "roman_urdu", "bukhar": "roman_urdu", "بخار اور کھانسی ہے": "urdu",
        "": "english", "   \n": "english", "kya hain?": "roman_urdu", "hai": "english",
    }
    got = rows("t STRING", *[(t,) for t in cases]).select("t", lang.detect_language(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in got} == cases


def test_translation_and_wording(rows):
    assert one(rows, "Tez bukhar", lang.translate_phrases) == "high fever"
    assert one(rows, "I have stomachache", lang.normalise_wording) == "i have abdominal pain"
    assert one(rows, "loose motions", lang.normalise_wording) == "diarrhea"
    assert one(rows, "لا  بab ✓12۳", lang.romanise) == "la bab 123"
    assert one(rows, "Body  ache, FEVER; feverish  water", lang.clean_reply_terms) == "jism mein dard, bukhar; feverish paani"


def test_triage_rules(rows):
    assert one(rows, " Hello!? ", lambda c: triage.greeting_kind(c, F.lit("english"))) == "greeting_english"
    assert one(rows, "kaise ho bhai", triage.is_greeting) is True
    assert one(rows, "hello doctor", triage.is_greeting) is False
    assert one(rows, "chest_pain with sweating", triage.is_emergency) is True
    assert one(rows, "severe headache and confusion", triage.is_emergency) is False
    assert one(rows, "severe headache and confusion", triage.is_emergency_all_words) is True
    assert one(rows, "cough then fever", triage.first_keyword) == "fever"
    assert one(rows, "any treatment", triage.asks_for_medicine) is True


def test_containment_for_short_and_long_lists(rows, values):
    texts = rows("id INT, t STRING", (1, "red flu and influenza"), (2, "no"), (3, "b"), (4, ""), (5, "é influenz"))
    names = rows("name STRING", ("flu",), ("influenza",), ("b",), ("a",), ("no",), ("Flu",), ("é",))
    near = contained_pairs(texts, names, "t", "name", ["id"])
    far = contained_pairs(texts, names, "t", "name", ["id"], block_bytes=20)
    want = sorted([(1, "a"), (1, "flu"), (1, "influenza"), (2, "no"), (3, "b"), (5, "flu"), (5, "é")], key=repr)
    assert values(near) == want and values(far) == want
    for size in (None, 20):
        out = longest_name(texts, names, "t", "name", "hit", block_bytes=size)
        assert {r.id: r.hit for r in out.collect()} == {1: "influenza", 2: "no", 3: "b", 4: None, 5: "Flu"}


def message_rows(rows):
    at = dt.datetime(2024, 1, 1)
    data = [("u", i, "human" if i % 2 == 0 else "ai", c, at + dt.timedelta(minutes=i), False) for i, c in enumerate(
        ["hello", "hi", "I have chills", "Malaria is possible", "what medicine?", "ok", "I have chest pain", "see a doctor"])]
    return rows("user_id STRING, seq INT, role STRING, content STRING, ts TIMESTAMP, is_reset BOOLEAN", *data)


def test_routes(spark, rows):
    out = triage_messages(message_rows(rows), tables.guidance(spark), tier_lists(tables.medicines(spark), "pos"))
    got = {r.seq: r for r in out.collect()}
    assert {k: v.route for k, v in got.items()} == {0: "greeting", 2: "generic", 4: "medicine", 6: "keyword"}
    assert got[4].disease == "Malaria" and "• Chloroquine" in got[4].reply and "consult a doctor" in got[6].reply


def test_memory(rows):
    messages = message_rows(rows)
    late = F.lit(dt.datetime(2024, 1, 2, 0, 8))
    assert chat.recent_memory(messages, F.lit(dt.datetime(2024, 1, 1, 1)), 3).count() == 3
    assert chat.recent_memory(messages, late).count() == 0
    frames = {r.seq: [m.content for m in r.messages] for r in chat.prompt_frames(messages).collect()}
    assert frames[0][1:] == ["hello"] and frames[6][1:] == ["I have chills", "Malaria is possible", "what medicine?", "ok", "I have chest pain"]
    reset = messages.withColumn("is_reset", F.col("seq") == 4)
    assert sorted(r.seq for r in chat.since_reset(reset).collect()) == [5, 6, 7]


def test_cleaning(rows):
    nested = rows("a STRUCT<b: ARRAY<STRING>, m: MAP<STRING,STRING>, n: INT>", (([" <b>x</b> "], {"k": "<i>y"}, 3),))
    got = cleanse.strip_all_markup(nested).first().a
    assert (got.b, got.m, got.n) == (["x"], {"k": "y"}, 3)
    assert one(rows, "a\x07b c d ", text.printable_only) == "abc d"
    assert one(rows, "abé\n", text.printable_ratio) == 0.5
    checked = cleanse.validate_messages(rows("content STRING", (" x ",), ("",), ("y" * 1001,)))
    assert [(r.content[:1], r.reason) for r in checked.collect()] == [("x", None), ("", "empty"), ("y", "too long")]


def test_documents(spark, rows):
    docs = rows("d ARRAY<STRING>", (["a\x00b", " \n", "c" * 400, "Dengue or Migraine"],))
    assert docs.select(chat.clean_documents(F.col("d")).alias("x")).first().x == ["ab", "c" * 300, "Dengue or Migraine"]
    messages = message_rows(rows).filter("seq < 3").withColumn("content", F.when(F.col("seq") == 2, "any treatment?").otherwise(F.col("content")))
    asked = messages.withColumn("documents", F.array(F.lit("nothing"), F.lit("on migraine"), F.lit("Dengue")))
    out = triage_messages(asked, tables.guidance(spark), tier_lists(tables.medicines(spark), "pos"))
    assert {r.seq: (r.route, r.disease) for r in out.collect()} == {0: ("greeting", "Migraine"), 2: ("medicine", "Migraine")}


def test_a_million_names(spark):
    """Names of several blocks; each text is read once for each of them."""
    names = spark.range(1_000_000).selectExpr("concat('n', hex(id * 7919), 'x') AS name")
    texts = spark.range(400).selectExpr("id", "concat('a n', hex(id * 250 * 7919), 'x and N', hex((id * 250 + 1) * 7919), 'X, nzzx') AS t")
    pairs = contained_pairs(texts, names, "t", "name", ["id"])
    assert pairs.count() == 400 and pairs.filter("name = concat('n', hex(id * 250 * 7919), 'x')").count() == 400
    best = longest_name(texts.limit(50), names, "t", "name", "hit")
    for row in best.collect():
        both = [f"n{n * 7919:X}x" for n in (row.id * 250, row.id * 250 + 1)]
        assert row.hit == min(both, key=lambda n: (-len(n), n))


def test_phrases_of_several_blocks(spark, rows):
    phrases = rows("phrase STRING", ("skin rash",), ("cough",), ("rash",), ("dry  cough",), (" ",), ("",), (None,))
    texts = rows("raw STRING", ("a skin rash with dry cough",), ("nothing",), ("coughing",))
    for size in (None, 20):
        out = possible(texts, phrases, F.col("raw"), "phrase", "found", "raw", block_bytes=size)
        assert {r.raw: r.found for r in out.collect()} == {
            "a skin rash with dry cough": ["dry  cough", "skin rash", "cough", "rash"], "nothing": [], "coughing": ["cough"]}
    assert possible(texts, phrases.limit(0), F.col("raw"), "phrase", "found", "raw").filter("size(found) > 0").count() == 0
