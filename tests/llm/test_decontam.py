import random

from clinflow.llm import decontam


def brute(item, text):
    """Least edit distance of the item to a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("xyz")
        elif kind == 1:
            text.insert(at, rng.choice("xyz"))
        else:
            del text[at]
    return "".join(text)


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontam.least_edits(item, decontam.masks(item), text) == brute(item, text)


def test_documents_equal_brute_force(spark, documents):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    items = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)] + ["too short"]
    texts = ["", None, "too short"]
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)
            body.insert(rng.randint(0, len(body)), edited(rng, item, rng.randint(0, int(len(item) * 0.08))).upper())
        texts.append("\n".join(body))
    table = spark.createDataFrame([*enumerate(items), (None, "x" * 50), (99, None)], "item_id long, text string")
    found = {r.doc_id: (r.contaminated, list(zip(r.items, r.edits))) for r in decontam.contaminated(documents(*texts), table).collect()}
    for i, text in enumerate(texts):
        plain, want = decontam.plain(text or ""), []
        for k, item in enumerate(items):
            n = brute(decontam.plain(item), plain)
            if len(item) >= decontam.LEAST_CHARS and n <= int(len(item) * decontam.EDIT_RATE):
                want.append((k, n))
        assert found[i] == (bool(want), want)
    assert sum(c for c, _ in found.values()) > 10


def test_odd_rows(spark, odd, documents):
    items = spark.createDataFrame([(1, "a benchmark item that nobody has ever seen before")], "item_id long, text string")
    assert sorted(map(repr, decontam.without_leaks(odd, items).collect())) == sorted(map(repr, odd.collect()))
    assert decontam.without_leaks(odd, items).columns == odd.columns
    assert decontam.contaminated(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontam.contaminated(documents(), items).count() == 0


def test_short_items_are_found(spark, documents):
    items = ["What is the capital of Peru?", "2 + 2 = ?", "art", "  ", "秘鲁的首都", "Why?"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = {
        "He asked: what is  the capital of Peru? Lima": [(0, 0)], "what is the capitol of Peru?": [(0, 1)], "what is a capitel of Peru?": [],
        "so 2 + 2 = ? is easy": [(1, 0)], "12 + 2 = ?": [], "a party": [], "party art": [(2, 0)], "ART": [(2, 0)], "art2": [], "(art)": [(2, 0)],
        "请问秘鲁的首都是哪里": [(4, 0)], "Why? Because": [(5, 0)], "why not": [], " ": [],
    }
    docs = documents(*texts)
    found = [list(zip(r.items, r.edits)) for r in decontam.contaminated(docs, table).orderBy("doc_id").collect()]
    assert found == list(texts.values())
    kept = [r.text for r in decontam.without_leaks(docs, table).orderBy("doc_id").collect()]
    assert kept == [text for text, hits in texts.items() if not hits]
