import random

import corpus_pipeline
import pytest
from test_near_dups import brute as near_classes

from clinflow.llm import decontam, mixing, quality


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(20) for _ in range(5)]
    rows = []
    for i in range(240):
        body = text(rng.randint(60, 200))
        if i % 10 == 1:
            body = " ".join(w + "$$$" for w in body.split())
        if i % 10 == 2:
            body += " " + items[i % 5]
        if i % 10 == 3:
            body = rows[-2][1] if rows[-2][1] else body
        if i % 10 == 4:
            body = rows[-4][1] + " extra"
        rows.append((i, body, "en", f"s{i % 3 if i % 2 else 0}", len(body)))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (None, text(80), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 10 != 1), 0) for i in range(0, 240) if i % 10 in (0, 1, 5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def test_stages_take_effect(spark, folder):
    sf, rows, items = folder
    result = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r._row.doc_id: r._row.text for r in quality.judged(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
    assert not any(i is not None and i < 240 and i % 10 == 1 for i in kept)
    assert all(i in kept for i, t, *_ in rows if i is not None and i < 240 and "$$$" not in t)
    named = [(i, t) for i, t in kept.items() if i is not None]
    classes = near_classes(named)
    left = [(i, t) for i, t in kept.items() if i is None or classes[i] == i]
    clean = [(i, t) for i, t in left if not any(decontam.plain(x) in decontam.plain(t) for x in items)]
    assert sorted(repr(r.doc_id) for r in result) == sorted(repr(i) for i, _ in clean)
    assert 100 < len(clean) < len(left) < len(kept) < len(rows)
    assert {r.shard for r in result} == set(range(8))
    totals = [sum(r.size for r in result if r.shard == k) for k in range(8)]
    assert max(totals) - min(totals) <= 2 * max(r.size for r in result)
    sources = {i: s for i, _, _, s, _ in rows}
    order = sorted(result, key=lambda r: (r.shard, r.slot))
    placed = {r.doc_id: (r._slot, r._within) for r in mixing.scheduled(docs.where(docs.doc_id.isin([i for i, _ in clean if i is not None]) | docs.doc_id.isNull())).collect()}
    assert [r.doc_id for r in order] == sorted(placed, key=lambda k: (*placed[k], f"={sources[k]}"))


def test_stage_columns(spark, folder):
    sf, *_ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]


def test_empty_documents(spark, folder, tmp_path):
    sf, *_ = folder
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
