"""Repair of the turn structure of conversations by a checkpointed dynamic program.

A repaired conversation has an optional system turn, then user and assistant in turns, and ends with the
assistant; no turn of it is blank or a duplicate. The cheapest edits are found backwards, from the last turn to the first.
"""

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clinflow.llm.common import bound_batches, partitions_of, table
from clinflow.session import send_by_value, written

send_by_value(__name__)

#: What a text may consist of and still be blank, and the signs a finished text ends with.
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: A turn as one byte: four times its kind plus its fault.
KINDS = "sua"
OTHER = 3
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
FAULTS = ("", "truncated", "blank", "duplicate")
#: Costs of the edits. Edits are written as D, I, K and R, in ASCII order.
DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3
#: Where a conversation stands: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads, and where a kept turn of each kind leads, if it is allowed.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Cost from each state at the end of a conversation.
FINAL = (0, 2 * INSERT, INSERT, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}
UNREACHED = 1 << 60


@lru_cache(maxsize=None)
def choices(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a turn in ASCII order: (edit, cost, next state)."""
    kind, fault = divmod(code, 4)
    more = UNFINISHED if fault == TRUNCATED else 0
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            if state in KEPT[kind]:
                edits.append(("K", more, KEPT[kind][state]))
            edits.append(("R", more + REROLE, NEXT[state]))
        out.append(tuple(edits))
    return tuple(out)


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost from each state before a turn, given that after it; turns may be inserted first."""
    here = [min(cost + after[to] for _, cost, to in edits) for edits in choices(code)]
    start, system, user, assistant = here
    return (
        min(start, INSERT + user, 2 * INSERT + assistant), min(system, INSERT + user, 2 * INSERT + assistant),
        min(user, INSERT + assistant), min(assistant, INSERT + user),
    )


def checkpoints(codes: bytes, end: tuple[int, ...], width: int) -> list[tuple[int, ...]]:
    """Cost vectors before turns 0, width, 2 width … and, last, at the end."""
    held, now = [end], end
    for i in range(len(codes) - 1, -1, -1):
        now = before(codes[i], now)
        if i % width == 0:
            held.append(now)
    return held[::-1]


def tight_edits(codes: bytes, end: tuple[int, ...], state: int, last: bool = True) -> tuple[str, int, int]:
    """The ASCII-least of the cheapest edits from `state`, the state they lead to, and their cost to the end of the conversation.

    `end` is the cost from each state after these turns. Only about √n cost vectors are kept; those between two checkpoints are computed
    again when the walk gets there. Turns may be inserted after the last one only if it is the `last` of its conversation.
    """
    width = isqrt(len(codes)) + 1
    marks = checkpoints(codes, end, width)
    edits, cost = [], marks[0][state]
    for k, first in enumerate(range(0, len(codes), width)):
        block = codes[first:first + width]
        inside = checkpoints(block, marks[k + 1], 1)
        for code, here, after in zip(block, inside, inside[1:]):
            while True:
                if DELETE + after[state] == here[state]:
                    edit, to = "D", state
                elif INSERT + here[NEXT[state]] == here[state]:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                else:
                    edit, to = next((e, to) for e, c, to in choices(code)[state] if c + after[to] == here[state])
                break
            edits.append(edit)
            state = to
    while last and state not in (START, ASSISTANT):
        edits.append("I")
        state = NEXT[state]
    return "".join(edits), state, cost


def passage(codes: bytes) -> list[list[int]]:
    """The least cost from each state before the turns to each state after them."""
    ways = [checkpoints(codes, tuple(0 if s == to else UNREACHED for s in range(4)), max(len(codes), 1))[0] for to in range(4)]
    return [[min(ways[to][s], UNREACHED) for to in range(4)] for s in range(4)]


def reached(way: list[list[int]], end: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(c + e for c, e in zip(costs, end)) for costs in way)


def digest() -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))


def initial(role: Column) -> Column:
    """The kind of a role by its first letter."""
    return F.when(F.startswith(role, F.lit("s")), 0).when(F.startswith(role, F.lit("u")), 1).when(F.startswith(role, F.lit("a")), 2).otherwise(OTHER)


def plain_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text: one space stands for each."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, code): every turn as a byte, `at` in the order of conversations and turns.

    Rows are cut by range, so that a conversation of any length is spread over many tasks. A row is a duplicate unless
    it is the first of its role and text in its conversation.
    """
    spark = rows.sparkSession
    bare = F.rtrim("text", F.lit(WHITE))
    narrow = rows.select(
        "conv_id", "turn", "role", digest().alias("digest"), initial(F.col("role")).alias("kind"), (bare == "").alias("blank"),
        F.right(bare, F.lit(1)).isin(*ENDS).alias("ended"), F.monotonically_increasing_id().alias("seq"),
    )
    order = ["conv_id", "turn", "role", "digest", "seq"]
    placed = narrow.repartitionByRange(partitions_of(spark), *order).sortWithinPartitions(*order)
    kept = written(placed.withColumn("at", F.monotonically_increasing_id()).drop("role", "seq"), "conversation-turns")
    firsts = kept.where("not blank").groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(CLEAN)
    return kept.join(firsts, "at", "left").select("conv_id", "turn", "at", (F.col("kind") * 4 + fault).cast("int").alias("code"))


FIGURES = ["blank", "duplicate", "truncated", "illegal"]


def piece_schema(conv: str) -> str:
    return (f"conv_id {conv}, at long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, "
            "last_turn long, first_kind int, last_kind int, cost long, audit string, codes binary, way array<array<bigint>>")


def pieces_of(conv: pa.DataType) -> Callable:
    """Turns in order to one row for every conversation, or for the part of it that one range of rows holds."""
    names = ["conv_id", "at", "whole", *FIGURES, "turns", "first_turn", "last_turn", "first_kind", "last_kind", "cost", "audit", "codes", "way"]
    long, text = pa.int64(), pa.string()
    kinds = [conv, long, pa.bool_(), *[long] * 7, pa.int32(), pa.int32(), long, text, pa.binary(), pa.list_(pa.list_(long))]

    def row(key, at, codes, turns, whole: bool) -> tuple:
        faults = [c % 4 for c in codes]
        illegal = sum((a // 4, b // 4) not in LEGAL for a, b in zip(codes, codes[1:]))
        edits, _, cost = tight_edits(bytes(codes), FINAL, START) if whole else (None, 0, None)
        return (key, at, whole, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, *turns, codes[0] // 4, codes[-1] // 4,
                cost, edits, None if whole else bytes(codes), None if whole else passage(bytes(codes)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, part, start, codes, turns, border = [], None, None, 0, bytearray(), [0, None, None], True
        for held in batches:
            for conv_id, turn, at, code in zip(*(held.column(name).to_pylist() for name in ("conv_id", "turn", "at", "code"))):
                if at >> 33 != part or conv_id != key:
                    if codes:  # the first and the last conversation of a range may go on in another
                        out.append(row(key, start, codes, turns, not border and at >> 33 == part))
                        if len(out) >= 4096:
                            yield batch(out)
                            out = []
                    border = at >> 33 != part
                    key, part, start, codes, turns = conv_id, at >> 33, at, bytearray(), [0, None, None]
                codes.append(code)
                if turn is not None and turn != turns[2]:
                    turns = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
        if codes:
            out.append(row(key, start, codes, turns, False))
        if out:
            yield batch(out)

    return run


def joined_pieces(held: pd.DataFrame) -> pd.DataFrame:
    """Figures of a conversation that lies in several ranges, and the costs after each of its pieces."""
    held = held.sort_values("at")
    turns, last_turn, last_kind, sums = 0, None, None, dict.fromkeys(FIGURES, 0)
    first_turn = None
    for piece in held.itertuples():
        for name in FIGURES:
            sums[name] += getattr(piece, name)
        sums["illegal"] += last_kind is not None and (last_kind, piece.first_kind) not in LEGAL
        last_kind = piece.last_kind
        if piece.turns:
            turns += piece.turns - (last_turn == piece.first_turn)
            first_turn, last_turn = piece.first_turn if first_turn is None else first_turn, piece.last_turn
    ends, now = [], FINAL
    for way in reversed(list(held["way"])):
        ends.append(list(now))
        now = reached([list(costs) for costs in way], now)
    gaps = last_turn - first_turn + 1 - turns if turns else 0
    return pd.DataFrame({"at": held["at"], "place": range(len(held)), "last": [False] * (len(held) - 1) + [True], "end": ends[::-1],
                         "gaps": int(gaps), **sums, "cost": now[START]})


def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of each piece from every state that it may be entered in."""
    for held in batches:
        rows = []
        for at, codes, end, last, place in zip(held["at"], held["codes"], held["end"], held["last"], held["place"]):
            for state in range(4) if place else (START,):
                edits, to, _ = tight_edits(bytes(codes), tuple(int(c) for c in end), state, bool(last))
                rows.append((at, state, to, edits))
        yield pd.DataFrame(rows, columns=["at", "state", "to", "edits"])


def chained(held: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece of a conversation is entered."""
    ways = {(at, state): to for at, state, to in zip(held["at"], held["state"], held["to"])}
    state, out = START, []
    for at in sorted(set(held["at"])):
        out.append((at, state))
        state = ways[at, state]
    return pd.DataFrame(out, columns=["at", "state"])


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with a row.

    Each turn's first fault counts: blank, duplicate (role and text seen before), truncated (the last sign is none of . ! ?).
    `gaps` are the turn numbers left out between the least and the largest. `audit` has a letter for every edit in order:
    K keep, D delete, I insert an empty turn, R give the role that is due; of the cheapest ones the ASCII-least.

    Turns stand in the order of `turn`, nulls first; equal turns in that of role, then of the SHA-256 of role and text. Rows are
    taken one by one, so that repeated rows are duplicates. A null role or text is one space, a null conv_id is a conversation;
    null turns count for no gap. An empty text is blank. Long texts are only hashed here. An empty table gives no
    rows; other columns are not read. A conversation of any length is worked on in the ranges its rows lie in, each with √n cost
    vectors; between ranges go four-by-four costs and the letters.
    """
    spark = rows.sparkSession
    conv = rows.schema["conv_id"].dataType.simpleString()
    turns = coded(plain_rows(rows))
    ranges = turns.withColumn("range", F.shiftright("at", 33)).repartition(partitions_of(spark), "range").sortWithinPartitions("at").drop("range")
    found = written(ranges.mapInArrow(pieces_of(to_arrow_type(rows.schema["conv_id"].dataType)), piece_schema(conv)), "conversation-pieces")
    spread = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0)
    result = ["conv_id", "gaps", *FIGURES, "cost", "audit"]
    whole = found.where("whole").withColumn("gaps", spread.cast("long")).select(*result)
    cut = found.where("not whole")
    figures = ", ".join(f"{name} long" for name in ["gaps", *FIGURES, "cost"])
    ends = written(cut.drop("codes", "audit", "cost", "whole").groupBy("conv_id").applyInPandas(
        joined_pieces, f"at long, place int, last boolean, end array<bigint>, {figures}"), "conversation-ends")
    ways = written(cut.select("at", "codes").join(ends.select("at", "place", "last", "end"), "at").mapInPandas(
        walked, "at long, state int, to int, edits string"), "conversation-walks")
    entered = cut.select("conv_id", "at").join(ways.drop("edits"), "at").groupBy("conv_id").applyInPandas(chained, "at long, state int")
    edits = ways.join(entered, ["at", "state"]).join(cut.select("conv_id", "at"), "at").join(ends, "at")
    joined = edits.groupBy("conv_id").agg(
        *[F.first(name).alias(name) for name in ["gaps", *FIGURES, "cost"]],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "edits"))), lambda p: p["edits"]), "").alias("audit"),
    )
    return whole.unionByName(joined.select(*result))


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) of each turn of the repaired conversations, and (conv_id, None, None) after the last one.

    Rows come sorted: for each conversation its edits, then its turns.
    """
    held = None
    for batch in batches:
        for conv_id, role, text, audit in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text", "audit"))):
            if audit is not None:
                if held is not None:
                    yield from inserted(*held)
                    yield held[0], None, None
                held = [conv_id, audit, 0, START]
                continue
            yield from inserted(*held)
            _, edits, at, state = held
            while edits[at] == "I":
                at, state = at + 1, NEXT[state]
            if edits[at] == "K":
                state = KEPT[KINDS.find(role[:1]) if role[:1] else OTHER][state]
                yield conv_id, role, text
            elif edits[at] == "R":
                state = NEXT[state]
                yield conv_id, ROLES[state], text
            held[2:] = at + 1, state
    if held is not None:
        yield from inserted(*held)
        yield held[0], None, None


def inserted(conv_id, edits: str, at: int, state: int) -> Iterator[tuple]:
    """The turns that the edits insert at this place."""
    while edits[at:at + 1] == "I":
        at, state = at + 1, NEXT[state]
        yield conv_id, ROLES[state], ""


def with_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Edits and turns of a conversation beside each other, in order."""
    spark = rows.sparkSession
    bound_batches(spark)
    conv = rows.schema["conv_id"].dataType.simpleString()
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(name) for name in names]
    turns = plain_rows(rows).select("conv_id", F.lit(1).alias("side"), "turn", "role", "text", digest().alias("digest"), *none("string", "audit"))
    edits = found.select("conv_id", F.lit(0).alias("side"), *none("long", "turn"), *none("string", "role", "text"), *none("binary", "digest"), "audit")
    both = edits.unionByName(turns).withColumn("conv_id", F.col("conv_id").cast(conv))
    return both.repartition(partitions_of(spark), "conv_id").sortWithinPartitions("conv_id", "side", "turn", "role", "digest").select(
        "conv_id", "role", "text", "audit")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that remain, with those inserted, from place 0.

    `found` are the `audits` of the rows; order and nulls are as there. Conversations stream through their task turn by turn.
    """
    conv = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches):
        out, place, size = [], 0, 0
        for conv_id, role, text in edited(batches):
            if role is None:
                place = 0
                continue
            out.append((conv_id, place, role, text))
            place, size = place + 1, size + len(text)
            if len(out) >= 4096 or size > 4_000_000:
                yield rows_of(out)
                out, size = [], 0
        if out:
            yield rows_of(out)

    def rows_of(out):
        kinds = [conv, pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["conv_id", "place", "role", "text"])

    return with_edits(rows, found).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of `role:text` of all turns of `repaired`, joined by newlines.

    A digest is serial, so the text of one conversation streams through one task, turn by turn.
    """
    conv = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches):
        out, state, any_turn = [], hashlib.sha256(), False
        for conv_id, role, text in edited(batches):
            if role is not None:
                state.update((b"\n" if any_turn else b"") + f"{role}:{text}".encode())
                any_turn = True
                continue
            out.append((conv_id, state.hexdigest()))
            state, any_turn = hashlib.sha256(), False
            if len(out) >= 4096:
                yield rows_of(out)
                out = []
        if out:
            yield rows_of(out)

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], conv), pa.array([r[1] for r in out])], ["conv_id", "repaired_sha256"])

    return with_edits(rows, found).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its . ! ?,
    3 repeats it, 4 makes it the user's. Nulls are one space, in the key as well."""
    key = F.concat_ws(":", *[F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")])
    kind = (F.crc32(key) % 20).cast("int")
    held = plain_rows(rows).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return held.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, audit and digest of every conversation; those without a row after the damage have zeros and an empty audit."""
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    found = audits(rows)
    names = [name for name in found.columns if name not in ("conv_id", "audit")]
    every = conversations.select("conv_id").distinct().select("conv_id", *[F.lit(0).cast("long").alias(name) for name in names], F.lit("").alias("audit"))
    all_found = written(found.unionByName(every).groupBy("conv_id").agg(
        *[F.max(name).alias(name) for name in names], F.max("audit").alias("audit")), "conversation-audits")
    digests = repaired_digests(rows, all_found)
    keyed = digests.select("conv_id", *[F.lit(None).cast("long").alias(n) for n in names], F.lit(None).cast("string").alias("audit"), "repaired_sha256")
    both = all_found.withColumn("repaired_sha256", F.lit(None).cast("string")).unionByName(keyed)
    return both.groupBy("conv_id").agg(*[F.max(n).alias(n) for n in [*names, "audit", "repaired_sha256"]])


#: The query in SQL: ways forward through the turns, the cheapest and then ASCII-least to each state.
CONVERSATION_REPAIR_SQL = """WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, o: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER o AS i, lag(left(role, 1)) OVER o AS previous,
    rtrim(text, E' \\t\\n\\x0B\\x0C\\r') AS bare
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text))),
turns AS (
  SELECT conv_id, turn, role, text, i, CASE WHEN bare = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    previous IS NOT NULL AND previous || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
insertions(state, later, audit, said) AS (VALUES
  ('', '', '', []::VARCHAR[]), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
  ('', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']), ('a', 'u', 'I', ['user:']),
  ('', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:'])),
follows(state, role) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edits(edit, price) AS (VALUES ('D', 4), ('K', 0), ('R', 3)),
ways AS (
  SELECT conv_id, 1::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM turns GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, state, cost, audit, said FROM (
    SELECT w.conv_id, w.i + 1 AS i, CASE edit WHEN 'D' THEN n.later ELSE f.role END AS state,
      w.cost + 3 * length(n.audit) + price + CASE WHEN edit <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END AS cost, w.audit || n.audit || edit AS audit,
      list_concat(w.said, n.said, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text]
        ELSE [CASE f.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text] END) AS said,
      row_number() OVER (PARTITION BY w.conv_id, CASE edit WHEN 'D' THEN n.later ELSE f.role END ORDER BY
        w.cost + 3 * length(n.audit) + price + CASE WHEN edit <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END, w.audit || n.audit || edit) AS best
    FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i JOIN insertions n ON n.state = w.state JOIN follows f ON f.state = n.later
      JOIN edits e ON edit = 'D' OR t.fault NOT IN ('blank', 'duplicate') AND (edit = 'K' AND f.role = left(t.role, 1) OR edit = 'R' AND f.role <> 's')
  ) WHERE best = 1),
ended AS (
  SELECT w.conv_id, w.cost + 3 * length(n.audit) AS cost, w.audit || n.audit AS audit, list_concat(w.said, n.said) AS said,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * length(n.audit), w.audit || n.audit) AS best
  FROM ways w JOIN (SELECT conv_id, max(i) + 1 AS i FROM turns GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i
    JOIN insertions n ON n.state = w.state WHERE n.later IN ('', 'a')),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
  coalesce(f.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.best = 1"""
