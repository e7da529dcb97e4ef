"""Repair of conversations at the least cost, in linear space.

Rows of a conversation are kept, given another role or deleted, and empty turns are inserted, so that
the roles read ``(s?(ua)+)?``. Four states tell where in that pattern one is: at the beginning, after the
system turn, after a user turn, after an assistant turn. To find the cheapest edits a conversation is cut
in the middle: costs run forwards from the start to the four states at the cut and backwards from the
end, the best state there is taken, and both halves go on alone. Of equally cheap states that of the
least edits so far is taken: edits up to a row are never a prefix of other edits up to it, so their
order, a number per state, is all that has to run along.

A conversation that is dealt to several partitions is repaired in pieces: each piece is summed up by
the costs and orders between any two states, the same cuts over the pieces give the states between
them, and then every piece is on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.llm.common import written
from isograd.session import checkpoint

#: States: at the beginning, after a system, a user, an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or renamed turn.
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bytes of text of a partition of rows.
PARTITION = 16 << 20
BLANKS = " \t\n\x0b\x0c\r"

#: From a state, by state: the cost and the order among equally cheap ways (their edits, or a number).
Moves = dict[int, dict[int, tuple[int, object]]]
Vector = dict[int, tuple[int, int]]


def _row_moves(initial: str, fault: str | None) -> Moves:
    """The cheapest inserts and one edit from any state to any other, for one row."""
    moves: Moves = {}
    more = TRUNCATED if fault == "truncated" else 0
    for state in range(4):
        found: dict[int, tuple[int, str]] = {}

        def take(target, cost, edits):
            found[target] = min(found.get(target, (cost, edits)), (cost, edits))

        after = state
        for inserts in range(3):  # more would come back to a state
            cost, edits = INSERT * inserts, "I" * inserts
            take(after, cost + DELETE, edits + "D")
            if fault not in ("blank", "duplicate"):
                take(FOLLOWING[after], cost + RENAME + more, edits + "R")
                if initial == "s" and after == EMPTY:
                    take(SYSTEM, cost + more, edits + "K")
                if initial == "a" and after == USER:
                    take(ASSISTANT, cost + more, edits + "K")
                if initial == "u" and after != USER:
                    take(USER, cost + more, edits + "K")
            after = FOLLOWING[after]
        moves[state] = found
    return moves


_MOVES = {(initial, fault): _row_moves(initial, fault) for initial in ("s", "u", "a", "")
          for fault in (None, "truncated", "blank")}
#: The inserts that complete a conversation; all of them lead to one last state.
END: Moves = {EMPTY: {0: (0, "")}, SYSTEM: {0: (2 * INSERT, "II")}, USER: {0: (INSERT, "I")},
              ASSISTANT: {0: (0, "")}}


def moves_of(role: str, fault: str | None) -> Moves:
    initial = role[:1] if role[:1] in ("s", "u", "a") else ""
    return _MOVES[initial, "blank" if fault == "duplicate" else fault]


def forward(vector: Vector, parts: Iterable[Moves]) -> Vector:
    """The costs and orders of the states after the parts."""
    for moves in parts:
        best: dict[int, tuple] = {}
        for state, (cost, order) in vector.items():
            for target, (more, edits) in moves[state].items():
                way = (cost + more, order, edits)
                if target not in best or way < best[target]:
                    best[target] = way
        ranked = sorted(best, key=lambda s: best[s][1:])
        vector = {state: (best[state][0], order) for order, state in enumerate(ranked)}
    return vector


def backward(end: int, parts: Sequence[Moves]) -> dict[int, int]:
    """The costs from the states before the parts to the end."""
    costs = {end: 0}
    for moves in reversed(parts):
        costs = {state: min(more + costs[target] for target, (more, _) in found.items()
                            if target in costs)
                 for state, found in moves.items() if found.keys() & costs.keys()}
    return costs


def crossings(parts: Sequence[Moves], start: int, end: int) -> list[int]:
    """The states before each part and after the last, on the cheapest way of the least edits."""
    out = [start] * len(parts) + [end]
    halves = [(0, len(parts))]
    while halves:
        low, high = halves.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        before = forward({out[low]: (0, 0)}, parts[low:middle])
        after = backward(out[high], parts[middle:high])
        out[middle] = min(before.keys() & after.keys(),
                          key=lambda s: (before[s][0] + after[s], before[s][1]))
        halves += [(low, middle), (middle, high)]
    return out


def summary(parts: Sequence[Moves]) -> Moves:
    """The parts as one."""
    return {state: dict(forward({state: (0, 0)}, parts)) for state in range(4)}


def fault_of(role: str, text: str, seen: set) -> str | None:
    """blank, duplicate, truncated or None; seen holds the rows before and gets this one."""
    words = text.strip(BLANKS)
    again = (role, text) in seen
    seen.add((role, text))
    if not words:
        return "blank"
    return "duplicate" if again else None if words[-1] in ".!?" else "truncated"


def edited(rows: Sequence[tuple[str, str, str | None]], start: int = EMPTY, end: int | None = None
           ) -> Iterator[tuple[int, str, int, str, str]]:
    """(row, edit, cost, role, text) of (role, text, fault) rows, in order.

    Deleted rows have an edit too; inserted turns have the number of the row after them. Without an end
    state the rows are the last ones and what completes the conversation follows them.
    """
    parts = [moves_of(role, fault) for role, _, fault in rows]
    if end is None:
        parts, end = [*parts, END], 0
    states = crossings(parts, start, end)
    for i, moves in enumerate(parts):
        state = states[i]
        for edit in moves[state][states[i + 1]][1]:
            if edit == "I":
                state = FOLLOWING[state]
                yield i, edit, INSERT, ROLES[state], ""
                continue
            role, text, fault = rows[i]
            cost = TRUNCATED if fault == "truncated" and edit != "D" else 0
            if edit == "R":
                state = FOLLOWING[state]
                yield i, edit, cost + RENAME, ROLES[state], text
            else:
                yield i, edit, cost + (DELETE if edit == "D" else 0), role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of ``conv_id:turn``; null ids, turns, roles and texts are
    written as one space. Dropped rows stay as marks: ``gone`` is true, role and text are null.
    """
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"),
        shown("text").alias("text"),
        (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("code"))
    code = F.col("code")
    return rows.select(
        "conv_id", "turn",
        F.when(code == 0, None).when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 0, None).when(code == 1, "").when(code == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        (code == 0).alias("gone"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows in order of conversation and turn over partitions of bounded size, cut from their lineage.

    Boundaries are drawn once: the checkpoint keeps what went where. ``at`` grows along a conversation,
    and ``part`` is the partition.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(int(size // PARTITION) + 1, spark.sparkContext.defaultParallelism)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
             F.col("role").asc_nulls_first(), F.col("_tie").asc_nulls_first(), F.col("_row")]
    dealt = (rows.withColumn("_tie", F.md5("text")).withColumn("_row", F.monotonically_increasing_id())
             .repartitionByRange(count, *order).sortWithinPartitions(*order)
             .select("conv_id", "turn", "role", "text", "gone",
                     F.monotonically_increasing_id().alias("at")))
    return checkpoint(dealt.withColumn("part", F.shiftright("at", 33)))


def _key():
    """conv_id as a value that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


EDITS = ("turn long, was_role string, fault string, edit string, cost long, role string, text string, "
         "at long, place int")
_FIELDS = [("turn", pa.int64()), ("was_role", pa.string()), ("fault", pa.string()), ("edit", pa.string()),
           ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("at", pa.int64()),
           ("place", pa.int32())]


def _edit_rows(rows: list[tuple], start: int = EMPTY, end: int | None = None) -> Iterator[tuple]:
    """Output rows of (turn, role, text, at, fault) rows of one conversation or piece of it."""
    place, before = 0, -1
    for i, edit, cost, role, text in edited([(r[1], r[2], r[4]) for r in rows], start, end):
        place = place + 1 if i == before else 0
        before = i
        if edit == "I":  # after the last row: behind its own edit
            at = rows[i][3] if i < len(rows) else rows[-1][3] if rows else None
            yield None, None, None, edit, cost, role, text, at, place + (8 if i == len(rows) else 0)
        else:
            turn, was, _, at, fault = rows[i]
            yield turn, was, fault, edit, cost, role, text, at, place


def _batch(ids: list, kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS))],
        names=["conv_id", *(n for n, _ in _FIELDS)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of conversations that lie in one partition, whose rows follow each other."""
    none = object()
    current, rows, seen, first = none, [], set(), None
    ids, out, size, kind = [], [], 0, None

    def finish():
        nonlocal size
        got = list(_edit_rows(rows)) or [(None,) * 7 + (first, 0)]
        ids.extend([current] * len(got))
        out.extend(got)
        size += sum(len(r[6] or "") for r in got)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "gone", "at")]
        for conv, turn, role, text, gone, at in zip(*columns):
            if current is none or conv != current:
                if current is not none:
                    finish()
                    if len(ids) > 5000 or size > 16 << 20:
                        yield _batch(ids, kind, out)
                        ids, out, size = [], [], 0
                current, rows, seen, first = conv, [], set(), at
            if not gone:
                rows.append((turn, role, text, at, fault_of(role, text, seen)))
    if current is not none:
        finish()
        yield _batch(ids, kind, out)


def _faulted(key, rows: pa.Table, earlier: pa.Table) -> pa.Table:
    """The rows of a piece in order with their faults; earlier: prints of rows of the pieces before."""
    rows = rows.sort_by("at")
    before, seen, faults = set(earlier.column("print").to_pylist()), set(), []
    for role, text, gone, mark in zip(*(rows.column(n).to_pylist()
                                        for n in ("role", "text", "gone", "print"))):
        fault = None if gone else fault_of(role, text, seen)
        faults.append("duplicate" if mark in before and fault in (None, "truncated") else fault)
    return rows.append_column("fault", pa.array(faults, pa.string()))


def _summed(rows: pa.Table) -> pa.Table:
    """A piece as costs and orders from state to state, 16 numbers each, -1 where there is no way."""
    rows = rows.sort_by("at")
    parts = [moves_of(role, fault) for role, fault, gone in zip(
        *(rows.column(n).to_pylist() for n in ("role", "fault", "gone"))) if not gone]
    found = summary(parts)
    ways = [found[a].get(b, (-1, -1)) for a in range(4) for b in range(4)]
    return pa.table({"k": rows.column("k").slice(0, 1), "part": rows.column("part").slice(0, 1),
                     "costs": pa.array([[w[0] for w in ways]], pa.list_(pa.int64())),
                     "orders": pa.array([[w[1] for w in ways]], pa.list_(pa.int64()))})


def _states(rows: pa.Table) -> pa.Table:
    """The states at either side of each piece of a conversation; the last piece has no end state."""
    rows = rows.sort_by("part")
    parts = [{a: {b: (c[4 * a + b], o[4 * a + b]) for b in range(4) if c[4 * a + b] >= 0}
              for a in range(4)}
             for c, o in zip(rows.column("costs").to_pylist(), rows.column("orders").to_pylist())]
    states = crossings([*parts, END], EMPTY, 0)
    return pa.table({"k": rows.column("k"), "part": rows.column("part"),
                     "from_state": pa.array(states[:-2], pa.int32()),
                     "to_state": pa.array([*states[1:-2], None], pa.int32())})


def _piece(rows: pa.Table) -> pa.Table:
    """Edits of one piece, whose states are known."""
    rows = rows.sort_by("at")
    start, end = rows.column("from_state")[0].as_py(), rows.column("to_state")[0].as_py()
    own = [r for *r, gone in zip(*(rows.column(n).to_pylist() for n in (
        "turn", "role", "text", "at", "fault", "gone"))) if not gone]
    first = rows.column("at")[0].as_py()
    got = [r if r[7] is not None else (*r[:7], first, r[8])
           for r in _edit_rows(own, start, end)] or [(None,) * 7 + (first, 0)]
    return pa.Table.from_batches([_batch([rows.column("conv_id")[0].as_py()] * len(got),
                                         rows.schema.field("conv_id").type, got)])


def _edits(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edits of the conversations of one partition, in order within it, and of all others, in none."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {EDITS}"
    dealt = _dealt(rows)
    # a conversation in several partitions is the first or the last of each: two rows per partition
    ends = dealt.select("part", "at", _key().alias("k")).groupBy("part").agg(
        F.min_by("k", "at").alias("first"), F.max_by("k", "at").alias("last"))
    shared = written(ends.select("part", F.explode(F.array("first", "last")).alias("k"))
                     .groupBy("k").agg(F.countDistinct("part").alias("n")).where("n > 1").select("k"),
                     "conversations-in-pieces")
    if not shared.limit(1).count():
        return dealt.mapInArrow(_whole, schema), None
    keyed = dealt.withColumn("k", _key())
    # at most as many keys as partitions
    whole = keyed.join(F.broadcast(shared), "k", "left_anti").drop("k")
    pieces = keyed.join(F.broadcast(shared), "k", "left_semi").withColumn(
        "print", F.when(~F.col("gone"), F.sha2(F.to_json(F.array("role", "text")), 256)))
    earlier = (pieces.where("print IS NOT NULL").select("k", "part", "print").distinct()
               .groupBy("k", "print").agg(F.sort_array(F.collect_list("part")).alias("parts"))
               .where(F.size("parts") > 1)
               .select(F.col("k").alias("k"), F.col("print").alias("print"),
                       F.explode(F.slice("parts", 2, F.size("parts") - 1)).alias("part")))
    faulted = written(pieces.groupBy("k", "part").cogroup(earlier.groupBy("k", "part")).applyInArrow(
        _faulted, type(pieces.schema)(list(pieces.schema.fields)).add("fault", "string")),
        "conversation-pieces")
    sums = faulted.select("k", "part", "at", "role", "fault", "gone").groupBy("k", "part").applyInArrow(
        _summed, "k string, part long, costs array<long>, orders array<long>")
    states = written(sums.groupBy("k").applyInArrow(
        _states, "k string, part long, from_state int, to_state int"), "conversation-states")
    return (whole.mapInArrow(_whole, schema),
            faulted.join(states, ["k", "part"]).groupBy("k", "part").applyInArrow(_piece, schema))


def repair_edits(conversations: DataFrame) -> DataFrame:
    """A row per edit of the cheapest repair of each conversation: conv_id, turn, was_role, fault, edit
    (K keep, R another role, D delete, I insert), cost, role, text; (at, place) order a conversation's.

    Rows are taken by turn (nulls first), then role and the md5 of the text. Null roles and texts are one
    space; null ids are one conversation. Blank and repeated rows are deleted; kept rows that don't end in
    ``.``, ``!`` or ``?`` cost 3 more. The repaired conversation is the rows whose edit isn't D. Other
    columns are not read.
    """
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(n), F.lit(" ")).alias(n) for n in ("role", "text")), F.lit(False).alias("gone"))
    whole, pieces = _edits(rows)
    return whole if pieces is None else whole.unionByName(pieces)


class _Digest:
    """What is reported of one conversation, from its edits in order."""

    def __init__(self):
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.least = self.most = self.turn = None
        self.turns = self.illegal = self.cost = 0
        self.initial, self.audit, self.hash, self.lines = None, [], hashlib.sha256(), 0

    def add(self, turn, was, fault, edit, cost, role, text):
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += cost
        if edit != "D":
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + was[:1] not in ("su", "ua", "au")
        self.initial = was[:1]
        if turn is not None:
            self.turns += turn != self.turn
            self.least = turn if self.least is None else self.least
            self.turn = self.most = turn

    def row(self):
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


_DIGEST = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
           ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
           ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of edits in order; no more than a batch of them is held."""
    none = object()
    current, digest, ids, out, kind = none, None, [], [], None

    def packed():
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), *(pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_DIGEST))],
            names=["conv_id", *(n for n, _ in _DIGEST)])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, *rest in zip(*(batch.column(n).to_pylist() for n in (
                "conv_id", "turn", "was_role", "fault", "edit", "cost", "role", "text"))):
            if current is none or conv != current:
                if current is not none:
                    ids.append(current)
                    out.append(digest.row())
                current, digest = conv, _Digest()
            digest.add(*rest)
        if len(ids) > 5000:
            yield packed()
            ids, out = [], []
    if current is not none:
        ids.append(current)
        out.append(digest.row())
        yield packed()


def repair_digest(conversations: DataFrame) -> DataFrame:
    """A row per conversation: what was wrong with it, after damage, and digests of its repair.

    conv_id, gaps (missing turns), blank, duplicate, truncated, illegal (neighbouring roles), cost, audit
    (the edits), repaired_sha256 (of the ``role:text`` lines). A conversation all of whose rows were
    dropped has zeros and digests of nothing. Rows are ordered as in :func:`repair_edits`. The digest of a
    conversation in several partitions is taken over its edits in one pass of one task, in the memory of
    one batch: a checksum of a sequence can't be shared out.
    """
    whole, pieces = _edits(damaged(conversations))
    schema = (f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, "
              "duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")
    out = whole.mapInArrow(_digests, schema)
    if pieces is None:
        return out
    spread = (pieces.withColumn("k", _key()).repartition("k").sortWithinPartitions("k", "at", "place")
              .drop("k"))
    return out.unionByName(spread.mapInArrow(_digests, schema))


#: The same rows by a forward pass that carries the whole audit and text of each state.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, b AS c, 0 AS step FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1
  FROM bits WHERE step < 8),
sums AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
shown AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
                        || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations),
coded AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]::BIGINT)), 4294967295::BIGINT) % 20 AS code
  FROM shown, sums),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE code <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id
         ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again
  FROM ordered),
faults AS (
  SELECT *, CASE WHEN words = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN NOT right(words, 1) IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair
  FROM judged),
inserts(p, q, n, lines) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
  (0, 2, 1, 'user:' || chr(10)), (1, 2, 1, 'user:' || chr(10)), (3, 2, 1, 'user:' || chr(10)),
  (2, 3, 1, 'assistant:' || chr(10)), (0, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10)),
  (1, 3, 2, 'user:' || chr(10) || 'assistant:' || chr(10))),
renames(q, s, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
keeps(q, s, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
edits AS (
  SELECT conv_id, k, q, q AS s, 4 AS cost, 'D' AS edit, '' AS line FROM faults, (SELECT unnest([0, 1, 2, 3]) AS q)
  UNION ALL
  SELECT conv_id, k, q, s, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K',
         role || ':' || text || chr(10)
  FROM faults JOIN keeps USING (initial) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, k, q, s, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R',
         r.role || ':' || text || chr(10)
  FROM faults, renames r WHERE fault IN ('', 'truncated')),
steps AS (
  SELECT conv_id, k, p, s, 3 * n + cost AS cost, repeat('I', n) || edit AS audit, lines || line AS lines
  FROM edits JOIN inserts USING (q)),
path AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best
  FROM conversations
  UNION ALL
  SELECT path.conv_id, path.k + 1, steps.s,
         min({'cost': path.best.cost + steps.cost, 'audit': path.best.audit || steps.audit,
              'lines': path.best.lines || steps.lines})
  FROM path JOIN steps ON path.conv_id IS NOT DISTINCT FROM steps.conv_id AND steps.k = path.k + 1
       AND steps.p = path.s
  GROUP BY ALL),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (k > 1 AND NOT pair IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM faults GROUP BY conv_id),
ended AS (
  SELECT path.conv_id, min({'cost': best.cost + 3 * i.n, 'audit': best.audit || repeat('I', i.n),
                            'lines': best.lines || i.lines}) AS best
  FROM path LEFT JOIN counts ON path.conv_id IS NOT DISTINCT FROM counts.conv_id
       JOIN inserts i ON i.p = path.s AND (i.q = 3 OR i.p + i.q = 0)
  WHERE path.k = coalesce(counts.n, 0) GROUP BY path.conv_id)
SELECT ended.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(left(best.lines, greatest(length(best.lines) - 1, 0))) AS repaired_sha256
FROM ended LEFT JOIN counts ON ended.conv_id IS NOT DISTINCT FROM counts.conv_id
"""
