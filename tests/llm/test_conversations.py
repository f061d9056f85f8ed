import hashlib
import itertools
import random
import re
import zlib

import pytest
from clinflow.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """One conversation by the rules read word for word: every row keeps the cheapest way to each sequence state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    # a way: initials so far reduced to the last one, cost, audit, repaired turns
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    ways = {"": (0, "", ())}

    def grown(ways):
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[state]:
                        new = (cost + 3, audit + "I", (*out, f"{role}:"))
                        if role[0] not in ways or new[:2] < ways[role[0]][:2]:
                            ways[role[0]] = new
        return ways

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, out) in grown(ways).items():
            options = [(state, cost + 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in follows[state]:
                    options.append((role[0], cost + more, "K", (f"{role}:{text}",)))
                options += [(r[0], cost + more + 3, "R", (f"{r}:{text}",)) for r in ("user", "assistant") if r[0] in follows[state]]
            for to, price, edit, said in options:
                new = (price, audit + edit, (*out, *said))
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        ways = after
    cost, audit, out = min(v for k, v in grown(ways).items() if k in ("", "a"))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_rows(seed, conversations, longest, sloppy=False):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "No", "", " \n", "Why?", "ü!", "a:b\nc.", "x" * rng.randint(1, 9) + "."])
            rows.append((conv if rng.random() < 0.95 else None, turn if rng.random() < 0.9 else None, rng.choice([role, None]) if sloppy else role,
                         rng.choice([text, None]) if sloppy else text))
    rng.shuffle(rows)
    return rows


def found(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    audits = c.audits(table)
    digests = {r.conv_id: r.repaired_sha256 for r in c.repaired_digests(table, audits).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv_id]) for r in audits.collect()}


def by_conversation(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append((row[0], row[1], row[2] if row[2] is not None else " ", row[3] if row[3] is not None else " "))
    return out


@pytest.mark.parametrize("sloppy", [False, True])
def test_audits_equal_brute_force(spark, sloppy):
    rows = random_rows(7, 250, 12, sloppy)
    assert found(spark, rows) == {conv: brute(held) for conv, held in by_conversation(rows).items()}


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(3)
    kinds = ["user", "assistant", "user", "assistant", "system", "bot"]
    rows = [(1, i // 2, rng.choice(kinds), rng.choice(["Yes.", "No", "", "One more.", f"{i}!", f"{i}"])) for i in range(3000)]
    rows += random_rows(5, 30, 6)
    rows = [r if r[0] is not None else (2, *r[1:]) for r in rows]
    assert found(spark, rows) == {conv: brute(held) for conv, held in by_conversation(rows).items()}


def test_tight_edits_equal_every_enumeration():
    rng = random.Random(1)
    for _ in range(300):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(0, 5)))
        best = None
        for n in range(len(codes) + 5):
            for letters in itertools.product("DIKR", repeat=n):
                if n - letters.count("I") != len(codes):
                    continue
                state, at, cost, good = 0, 0, 0, True
                for letter in letters:
                    if letter == "I":
                        state, cost = c.NEXT[state], cost + 3
                        continue
                    step = [(price, to) for edit, price, to in c.choices(codes[at])[state] if edit == letter]
                    if not step:
                        good = False
                        break
                    cost, state, at = cost + step[0][0], step[0][1], at + 1
                if good and state in (c.START, c.ASSISTANT) and (best is None or (cost, "".join(letters)) < best):
                    best = (cost, "".join(letters))
            if n >= len(codes) + 2 and len(codes) > 3:
                break
        edits, _, cost = c.tight_edits(codes, c.FINAL, c.START)
        assert cost <= best[0] and (cost, edits) <= best
        if cost == best[0]:
            assert edits == best[1]


def test_checkpoints_are_few():
    codes = bytes(random.Random(2).randrange(16) for _ in range(10_000))
    assert len(c.checkpoints(codes, c.FINAL, 101)) <= 101
    edits, _, cost = c.tight_edits(codes, c.FINAL, c.START)
    assert sum(e != "I" for e in edits) == 10_000 and cost == c.checkpoints(codes, c.FINAL, 1)[0][c.START]


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (2, 0, "user", " "), (3, 0, "user", "Hi!")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as audit", "2 as at", "3 as place", "4 as code")
    audits = c.audits(table)
    assert {r.conv_id: (r.audit, r.cost, r.illegal) for r in audits.collect()} == {1: ("KIKD", 7, 2), 2: ("D", 4, 0), 3: ("KI", 3, 0)}
    got = {}
    for r in sorted(c.repaired(table, audits).collect()):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    initials = {conv: "".join(role[0] for role, _ in said) for conv, said in got.items()}
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in initials.values())
    assert got[3] == [("user", "Hi!"), ("assistant", "")] and 2 not in got
    assert got[1] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")]


def test_empty_nulls_and_repeats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    audits = c.audits(empty)
    assert audits.count() == 0 and c.repaired(empty, audits).count() == 0
    long = "word " * 200_000 + "end."
    rows = [(None, None, None, None), (None, None, None, None), (4, None, "user", long), (4, None, "user", long), (4, 1, "assistant", "")]
    assert found(spark, rows) == {conv: brute(held) for conv, held in by_conversation(rows).items()}


def test_query_equals_brute_force(spark, tmp_path):
    rows = random_rows(11, 120, 9) + [(500, 3, "user", "a."), (501, None, None, None)]
    rows += [(900 + i, 0, "user", "only.") for i in range(60)]  # some conversations lose their only row
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {conv: brute(held) for conv, held in by_conversation(brute_damage(rows)).items()}
    for conv in {r[0] for r in rows} - set(want):
        want[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = c.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == want
