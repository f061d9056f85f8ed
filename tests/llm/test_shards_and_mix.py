import math
import zlib
from fractions import Fraction

import pytest
from clinflow.llm import mixing, sharding


def brute_shards(rows, shards):
    sizes = [(doc_id, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for doc_id, text in rows]
    total, before, out, slots = sum(s for _, s, _ in sizes), 0, [], {}
    target = math.ceil(total / shards)
    for doc_id, size, crc in sizes:
        shard = before // target
        out.append((doc_id, size, crc, "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def test_shards_equal_brute_force(documents):
    rows = [(i, "é" * (i * 37 % 101) + "x" * (i % 13)) for i in range(400)]
    found = sharding.place(documents(*((i, t, "s") for i, t in reversed(rows))))
    want = brute_shards(rows, 8)
    assert sorted(tuple(r) for r in found.collect()) == want
    sizes = [sum(r[1] for r in want if r[4] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in want)


def test_shards_of_odd_rows(odd, documents):
    found = sharding.place(odd).collect()
    assert len(found) == odd.count()
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert {r.size for r in found if r.doc_id in (1, 2)} == {1}
    assert sharding.place(documents()).count() == 0


def test_period_is_proportionally_fair():
    slots = mixing.quanta({"a": 5, "b": 3.3, "c": 1, "d": 0.01, "e": 0}, 256)
    assert sum(slots.values()) == 256 and min(slots.values()) == 1
    order = mixing.period_schedule(slots)
    assert [slot for _, _, slot in order] == list(range(256))
    taken = dict.fromkeys(slots, 0)
    for name, j, slot in order:
        assert j == taken[name]
        taken[name] += 1
        assert all(abs(taken[k] - slots[k] / 256 * (slot + 1)) < 1 for k in slots)
    assert taken == slots


def test_mix_holds_the_weights(documents):
    rows = [(i, "x" * 99, f"s{i % 4 if i % 2 else 0}") for i in range(4000)]
    found = mixing.scheduled(documents(*rows), {"s0": 0.5, "s1": 0.3, "s3": 0.2}, block_bytes=500, period=64).collect()
    assert sorted(r.doc_id for r in found) == list(range(4000))
    found.sort(key=lambda r: (r._slot, r._within, r._source))
    counts, ends = {}, {"=s0": 2000, "=s1": 1000, "=s3": 1000}
    slots = mixing.quanta({"=s0": 0.5, "=s1": 0.3, "=s3": 0.2}, 64)
    for n, r in enumerate(found, 1):
        counts[r._source] = counts.get(r._source, 0) + 1
        assert all(abs(counts.get(k, 0) - slots[k] / 64 * n) < 2 * 5 + 1 for k in slots)
        if counts[r._source] == ends[r._source]:
            break


def test_mixed_keeps_all_rows_in_order(odd, documents, spark, tmp_path):
    found = mixing.mixed(odd)
    assert found.columns == odd.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, odd.collect()))
    assert mixing.mixed(documents()).count() == 0
    docs = documents(*((i, f"text {i} " * 50, f"s{i % 7 % 3}") for i in range(300)))
    places = {r.doc_id: (r._slot, r._within) for r in mixing.scheduled(docs).collect()}
    mixing.mixed(docs).write.parquet(str(tmp_path / "mix"))
    read = spark.read.parquet(str(tmp_path / "mix")).selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index r").collect()
    order = [r.doc_id for r in sorted(read, key=lambda r: (r.f, r.r))]
    assert order == sorted(places, key=lambda k: places[k])


def test_null_source_is_its_own(documents):
    found = mixing.scheduled(documents((1, "a", None), (2, "b", ""), (3, "c", "null"))).collect()
    assert len({r._source for r in found}) == 3


@pytest.mark.parametrize("names", [0, 1, 50])
def test_quanta_hold_any_number_of_sources(names):
    slots = mixing.quanta({f"s{i}": i for i in range(names)}, 64) if names else {}
    assert len(slots) == names and all(n >= 1 for n in slots.values())


def test_prefixes_of_many_periods_hold_the_true_weights():
    weights = {f"s{i:03}": 1.0 + i % 7 / 3 for i in range(199)} | {"heavy": 110.0}
    total = sum(map(Fraction, weights.values()))
    shares, rest = mixing.whole_shares(weights)
    names, taken = list(shares), dict.fromkeys(weights, 0)
    assert not rest
    for n, (k, j, slot) in enumerate(mixing.dealt(list(shares.values()), [10**9] * len(names)), 1):
        assert slot == n - 1 and j == taken[names[k]]
        taken[names[k]] += 1
        if n % 997 == 0 or n < 100:
            assert all(abs(taken[name] - Fraction(weights[name]) / total * n) < 1 for name in names)
        if n == 12 * mixing.PERIOD:
            break


def test_mix_holds_a_heavy_source_among_many(documents, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 50)  # many tasks deal
    rows = [(i, "x" * 99, "heavy" if i < 2000 else f"s{i % 40}") for i in range(2800)] + [(2800 + i, "x" * 99, "none") for i in range(5)]
    weights = {f"s{i}": 1.0 for i in range(40)} | {"heavy": 40.0}
    found = mixing.scheduled(documents(*rows), weights, block_bytes=100).collect()
    assert sorted(r.doc_id for r in found) == list(range(2805))
    found.sort(key=lambda r: r._slot)
    assert len({r._slot for r in found}) == 2805 and {r._source for r in found[-5:]} == {"=none"}
    counts = {}
    for n, r in enumerate(found[:1600], 1):  # until the light sources are used up
        assert r._slot == n - 1
        counts[r._source] = counts.get(r._source, 0) + 1
        assert abs(counts.get("=heavy", 0) - n / 2) < 1
        assert all(abs(counts.get(f"=s{i}", 0) - n / 80) < 1 for i in range(40))
