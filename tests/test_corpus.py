import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinflow.functions.batched import boundary_chunks_of
from clinflow.operators import medicines, neighbours
from clinflow.operators.neighbours import nearest
from clinflow.sources import corpus, matrix


def test_qa_csv(spark, tmp_path):
    path = tmp_path / "qa.csv"
    path.write_text('Question ,The Answer,Focus Area\n"What, is\nit?","  An ""illness"" ",Flu\nx,,Flu\ny,"  ",Flu\n,z,Cold\n', encoding="utf-8")
    got = sorted(r.content for r in corpus.qa_documents(corpus.read_qa_csv(spark, str(path))).collect())
    assert got == ["Disease: Cold\nQuestion: \nAnswer: z", 'Disease: Flu\nQuestion: What, is\nit?\nAnswer: An "illness"']


def test_json_corpora(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"title": "T" * 130, "content": " text ", "pubid": "7"}, {"content": "  "}, {"content": "c"}]))
    records = corpus.read_json_records(spark, str(path), "array")
    got = {r.content: (r.disease, r.meta["pubid"]) for r in corpus.article_documents(records).collect()}
    assert got == {"text": ("T" * 120, "7"), "c": ("General", "")}
    assert corpus.read_json_records(spark, str(tmp_path / "none.json")).count() == 0
    records.coalesce(1).write.json(str(tmp_path / "lines"))
    assert sorted(map(repr, corpus.read_json_records(spark, str(tmp_path / "lines")).collect())) == sorted(map(repr, records.collect()))
    assert [r.disease for r in corpus.flashcard_documents(records).collect()] == ["General Medical"] * 2


def test_articles_and_cards(rows):
    articles = rows("question STRING, long_answer STRING, context STRUCT<contexts: ARRAY<STRING>>, final_decision STRING, pubid INT",
                    (" Q? ", "A", ([" one ", None, "", "two"],), "yes", 5), ("Q", None, None, None, 6), ("R", "B", None, None, None))
    got = {r.pubid: r.content for r in corpus.article_records(articles).collect()}
    assert got == {"5": "Question: Q?\nAbstract: one two\nConclusion: A\nDecision: yes", "": "Question: R\nConclusion: B"}
    cards = rows("instruction STRING, output STRING", (None, "o"), ("i", " o "), ("i", None))
    assert sorted(r.content for r in corpus.flashcard_records(cards, "s").collect()) == ["Question: i\nAnswer: o", "o"]


def test_pages(rows):
    html = ('<html><script>var x="</p>";</script><a class="k" href="/a/detail/x">l</a><a href="//h/detail/y">m</a>'
            '<a href="detail/z">n</a><a href="http://q/detail/w">n</a><a href="/other">o</a><p>' + "w &amp;lt; " * 40 + "</p></html>")
    pages = rows("url STRING, html STRING", ("http://site/one/yellow-fever/", html), ("http://site/one/short", "<p>hi</p>"))
    assert sorted(r.link for r in corpus.page_links(pages, "detail/").collect()) == [
        "http://h/detail/y", "http://q/detail/w", "http://site/a/detail/x", "http://site/one/yellow-fever/detail/z"]
    got = corpus.page_records(pages).collect()
    assert [r.title for r in got] == ["Yellow Fever"] and "w &lt; w" in got[0].content and "var x" not in got[0].content


def test_chunks(rows):
    text = "".join(chr(97 + i % 26) for i in range(1451))
    got = corpus.chunk_documents(rows("id INT, content STRING", (1, text), (2, ""), (3, "short"))).orderBy("id", "chunk_no").collect()
    assert [(r.id, r.chunk_no, len(r.content)) for r in got] == [(1, 0, 500), (1, 1, 500), (1, 2, 500), (1, 3, 101), (3, 0, 5)]
    assert all(text[450 * r.chunk_no:][:500] == r.content for r in got if r.id == 1)


def test_boundary_chunks_keep_every_word():
    text = "\n\n".join(" ".join(f"w{p}x{i}" for i in range(200)) for p in range(3)) + "\n" + "z" * 1300
    chunks = boundary_chunks_of(text, 500, 50)
    assert max(map(len, chunks)) <= 500
    words = [w for c in chunks for w in c.split()]
    assert set(w for w in text.split() if len(w) < 50) <= set(words)
    assert boundary_chunks_of("a b", 500, 50) == ["a b"]
    assert boundary_chunks_of("aa bb cc dd", 5, 2) == ["aa bb", "cc", "dd"]


@pytest.mark.parametrize("sizes", [{}, {"pivots": 3, "block_items": 40, "block_queries": 30}])
def test_nearest_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 8)).round(2)
    points[100:200] = points[0]  # a third of all vectors are copies
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "item_id INT, vector ARRAY<DOUBLE>")
    got = {}
    for r in nearest(table.withColumnRenamed("item_id", "query_id"), table, 5, **sizes).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
    exact = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2)
    for i in range(300):
        want = np.lexsort((np.arange(300), exact[i].round(9)))[:5]
        assert [got[i][k + 1] for k in range(5)] == list(want)


def test_drug_entries(rows, values):
    labels = rows(
        "pos INT, openfda STRUCT<brand_name: ARRAY<STRING>, generic_name: ARRAY<STRING>, substance_name: ARRAY<STRING>>, indications_and_usage ARRAY<STRING>",
        (1, ([" alpha ", "beta"], ["ALPHA"], ["d e", "zeta", "eta"]), ["For Malaria fever"]),
        (2, (["gamma"], None, None), ["malaria"]), (3, None, None), (4, (["four"], None, None), ["malaria"]), (5, (["five"], None, None), ["malaria"]))
    held = medicines.label_names(labels)
    assert held.filter("pos = 1").first().names == ["Alpha", "Beta", "D E", "Eta", "Zeta"]
    terms = rows("disease STRING, term STRING, pos INT", ("Malaria", "MALARIA", 0), ("Malaria", "nothing", 1), ("Malaria", "fever", 2))
    found = medicines.label_drugs(held, terms, "pos")
    assert sorted(r.drug_name for r in found.collect()) == ["Alpha", "Alpha", "Beta", "Beta", "D E", "D E", "Eta", "Eta", "Five", "Four", "Gamma", "Zeta", "Zeta"]
    few = medicines.label_drugs(medicines.label_names(labels, names_per_label=4), terms, "pos", terms_per_disease=2, labels_per_term=3)
    assert sorted(r.drug_name for r in few.collect()) == ["Alpha", "Beta", "D E", "Eta", "Four", "Gamma"]
    static = rows("disease STRING, drug_name STRING, kind STRING, pos INT", ("Malaria", "Gamma", "otc", 1), ("Malaria", "Gamma", "rx", 2))
    label = found.select("disease", "drug_name", F.lit("rx").alias("kind"), F.col("label_pos").alias("pos"))
    merged = medicines.first_wins([(0, static), (1, label)])
    assert {r.drug_name: r.kind for r in merged.collect()}["Gamma"] == "otc" and merged.count() == 8
    assert values(medicines.new_drugs(merged, static).select("drug_name"))[0] == ("Alpha",)


def test_matrix(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("Itching, Skin Rash ,Prognosis,Unnamed: 3\n1,,Flu ,x\n0,1, Cold,\n,1,Flu,\n")
    clean = matrix.clean_matrix(matrix.read_matrix(spark, str(path)))
    assert clean.columns == ["itching", "skin_rash", "label"]
    assert sorted(map(tuple, clean.collect())) == [(0, 1, "Cold"), (0, 1, "Flu"), (1, 0, "Flu")]
    assert {r.disease: r.features for r in matrix.disease_symptoms(clean).collect()} == {"Flu": ["itching", "skin_rash"], "Cold": ["skin_rash"]}
    facts = matrix.profile(clean).first()
    assert (facts["rows"], facts.features, facts.classes, facts.labels) == (3, 2, 2, ["Cold", "Flu"])
    aligned = matrix.first_matrix(spark, [str(tmp_path / "no.csv"), str(path)], ["skin_rash", "cough"])
    assert aligned.columns == ["skin_rash", "cough", "label"]
    assert matrix.first_matrix(spark, [str(tmp_path / "no.csv")], ["a"]) is None and matrix.merge_samples(None, None) is None


def test_failed_part_is_left_out(spark, tmp_path):
    out = corpus.union_readable([lambda: spark.range(2), lambda: spark.read.parquet(str(tmp_path / "none"))])
    assert out.count() == 2


def test_links_as_a_browser_reads_them(rows):
    html = """<a href='/a/x'>1</a><a class=k href=b/x?q=1&amp;r=2>2</a><A HREF = "../x">3</A><a href="./c/../x#f">4</a><a data-href="/no/x">5</a>
      <a title="a > b" href="&#47;e&#x2F;x">6</a><a href=" /pad/x ">7</a><a href="?x">8</a><a href="mailto:x@y">9</a><abbr href="/no/x">"""
    pages = rows("url STRING, html STRING", ("http://h/one/two?z", html))
    assert {r.link for r in corpus.page_links(pages, "x").collect()} == {
        "http://h/a/x", "http://h/one/b/x?q=1&r=2", "http://h/x", "http://h/one/x#f", "http://h/e/x", "http://h/pad/x", "http://h/one/two?x", "mailto:x@y"}


def test_text_keeps_comparisons_and_all_signs(rows):
    html = "<p class='a>b'>5 < 6 and a > b</p><!-- <p>no</p> --><p>&copy; &middot; &eacute; &#233; &#xE9; &amp;lt; &bogus; R&D &#128512;</p>"
    got = rows("html STRING", (html,)).select(corpus.visible_text(F.col("html")).alias("t")).first().t
    assert got == "5 < 6 and a > b © · é é é &lt; &bogus; R&D \U0001F600"


def test_a_mistyped_column_is_not_a_missing_corpus(spark, rows):
    from pyspark.errors import AnalysisException
    import pytest

    with pytest.raises(AnalysisException):
        corpus.union_readable([lambda: rows("a INT", (1,)).select("b")])


def test_few_pairs_are_compared_exactly(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("embedding is not null")
    items = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    seen = []
    kept = neighbours._candidates

    def counted(bounded, k):
        seen.append(kept(bounded, k).count())
        return kept(bounded, k)

    monkeypatch.setattr(neighbours, "_candidates", counted)
    asked = items.withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r.rank): r.item_id for r in nearest(asked, items, 4, pivots=8, block_items=100).collect()}
    held = sorted((r.item_id, list(r.vector)) for r in items.collect())
    ids, points = np.array([i for i, _ in held]), np.array([v for _, v in held], np.float64)
    assert seen[0] < 0.1 * len(ids) ** 2
    for i, point in zip(ids, points):
        order = np.lexsort((ids, ((points - point) ** 2).sum(1)))[:4]
        assert [got[i, k] for k in range(1, 5)] == list(ids[order])


def test_copies_of_a_vector_are_taken_by_id(spark):
    items = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(900, [1.0, 2.001]), (901, [5.0, 5.0])], "item_id int, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.001]), (3, [5.0, 5.0])], "query_id int, vector array<double>")
    got = nearest(asked, items, 3, pivots=2, block_items=50).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 900), (2, 0), (2, 1), (3, 901), (3, 900), (3, 0)]


def test_approximations_bound_the_rest():
    points = np.random.default_rng(4).normal(size=(50, 16))
    points[0] = 3.0
    codes, low, step, error = neighbours._approximated(points)
    back = low[:, None] + step[:, None] * codes
    assert np.allclose(np.sqrt(((points - back) ** 2).sum(1)), error) and error[0] == 0
    assert (np.abs(points - back) <= step[:, None] * 0.5 + 1e-9).all()


def test_queries_with_copies_among_the_items_meet_no_block(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(i % 50), 1.0]) for i in range(200)], "item_id int, vector array<float>")
    asked = items.filter("item_id < 60").select(F.col("item_id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    monkeypatch.setattr(neighbours, "_bounds_in_block", None)
    got = {}
    for row in nearest(asked, items, 3).collect():
        got.setdefault(row.query_id, {})[row.rank] = (row.item_id, row.distance)
    assert got == {i: {k + 1: (i % 50 + 50 * k, 0.0) for k in range(3)} for i in range(60)}


def test_queries_and_items_that_repeat(spark):
    items = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (2, [1.0]), (2, [4.0]), (3, [9.0])], "item_id int, vector array<float>")
    asked = spark.createDataFrame([("a", [0.0]), ("a", [0.0]), ("b", [4.0]), ("b", [9.0])], "query_id string, vector array<float>")
    got = nearest(asked, items, 3, pivots=2, block_items=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id, r.distance) for r in got] == [("a", 1, 0.0), ("a", 1, 0.0), ("a", 1, 0.0), ("b", 2, 0.0), ("b", 3, 0.0), ("b", 2, 9.0)]


def test_boundary_check_shuffles_no_texts(spark, tmp_path):
    from catalog.corpus import QUERIES

    text = " ".join(["word"] * 300)
    data = [(1, text), (1, text), (1, "other"), (2, "x" * 700), (3, "  "), (4, None), (5, "")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["f18_boundary_chunks"](spark, str(tmp_path))
    shuffled = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "collect_list" in line]
    assert not shuffled
    assert sorted(tuple(r) for r in out.collect()) == [(1, True, True), (1, True, True), (2, True, False)]
