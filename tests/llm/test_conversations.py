import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from isograd.llm import conversations
from isograd.llm.conversations import EMPTY, crossings, edited, fault_of, moves_of

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(rows):
    """(cost, audit, lines) by a pass that carries whole audits; rows of (role, text, fault)."""
    best = {0: (0, "", ())}

    def insert(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                new = (cost + 3, audit + "I", (*lines, ("user:", "assistant:")[NEXT[s] == 3]))
                best[NEXT[s]] = min(best.get(NEXT[s], new), new)
        return best

    for role, text, fault in rows:
        found = {}
        # inserts before the row, then one edit: all combinations
        ways = []
        for s, (cost, audit, lines) in best.items():
            state, c, a, out = s, cost, audit, lines
            for _ in range(4):
                ways.append((state, c, a, out))
                state = NEXT[state]
                c, a, out = c + 3, a + "I", (*out, "user:" if state == 2 else "assistant:")
        for s, c, a, out in ways:
            more = 3 if fault == "truncated" else 0
            options = [(s, c + 4, a + "D", out)]
            if fault not in ("blank", "duplicate"):
                to = NEXT[s]
                options.append((to, c + 3 + more, a + "R",
                                (*out, f"{'user' if to == 2 else 'assistant'}:{text}")))
                keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                if keep:
                    options.append((keep, c + more, a + "K", (*out, f"{role}:{text}")))
            for to, *way in options:
                found[to] = min(found.get(to, tuple(way)), tuple(way))
        best = found
    ended = []
    for s, way in best.items():
        for _ in range(3):
            if s in (0, 3):
                ended.append(way)
            s, way = NEXT[s], (way[0] + 3, way[1] + "I",
                               (*way[2], "user:" if NEXT[s] == 2 else "assistant:"))
    return min(ended)


def some(rng, n):
    texts = ["Yes.", "No!", "so it goes", "", " \t", "Why?", "then\x0b", "a.b", "é…"]
    roles = ["user", "assistant", "system", "tool", "", "user"]
    return [(rng.choice(roles), rng.choice(texts) + (str(i) + "." if rng.random() < 0.5 else ""))
            for i in range(n)]


def judged(rows):
    seen = set()
    return [(role, text, fault_of(role, text, seen)) for role, text in rows]


def test_cheapest_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = judged(some(rng, rng.choice([0, 1, 2, 3, 5, 8, 13, 40])))
        got = list(edited(rows))
        cost, audit, lines = cheapest(rows)
        assert "".join(e for _, e, *_ in got) == audit and sum(g[2] for g in got) == cost
        assert [f"{g[3]}:{g[4]}" for g in got if g[1] != "D"] == list(lines)


def test_summaries_give_the_same_states():
    rng = random.Random(2)
    for _ in range(300):
        rows = judged(some(rng, rng.randint(1, 60)))
        parts, pieces, at = [moves_of(r, f) for r, _, f in rows], [], [0]
        while at[-1] < len(parts):
            at.append(at[-1] + rng.randint(0, 9))
            pieces.append(conversations.summary(parts[at[-2]:at[-1]]))
        states = crossings([*pieces, conversations.END], EMPTY, 0)
        full = crossings([*parts, conversations.END], EMPTY, 0)
        assert states[:-2] == [full[i] for i in at[:-1]]


def wanted(rows):
    """The digest of every conversation, from original rows."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(":".join(shown).encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        kept += [] if code == 0 else [(turn, role, text)] * (2 if code == 3 else 1)
    for conv, kept in out.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                 hashlib.md5(r[2].encode()).hexdigest()))
        rows = judged([r[1:] for r in kept])
        turns = [r[0] for r in kept if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        cost, audit, lines = cheapest(rows)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(sum(f == name for *_, f in rows) for name in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def corpus():
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(120)]:
        n = 400 if conv in (7, None) else rng.choice([1, 1, 2, 4, 6, 9])
        for i, (role, text) in enumerate(some(rng, n)):
            turn = None if rng.random() < 0.03 else i if rng.random() < 0.9 else i + rng.randint(0, 3)
            rows.append((conv, turn, None if rng.random() < 0.02 else role,
                         None if rng.random() < 0.02 else text))
    rows += [(500, 1, "user", "one?")] * 300 + [(501, None, None, None)] * 3
    rows += [(600, 0, "user", "x" * 40000), (600, 1, "assistant", "y" * 40000 + ".")]
    dropped = [t for t in range(200) if zlib.crc32(f"700:{t}".encode()) % 20 == 0]
    return rows + [(700, t, "user", "gone") for t in dropped]


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_digests(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "PARTITION", size)
    rows = corpus()
    random.Random(9).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                               SCHEMA + ", gone string, part int, k int").repartition(3)
    got = conversations.repair_digest(df).collect()
    want = wanted(rows)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert want[700] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_sql(spark):
    rows = corpus()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype(
        {"conv_id": "Int64", "turn": "Int64"}))
    got = {r[0]: tuple(r[1:]) for r in con.execute(conversations.SQL).fetchall()}
    assert got == wanted(rows)


def test_edits_and_empty_table(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Hello."), (1, 2, "assistant", "so"), (2, 5, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(conversations.repair_edits(df).collect(), key=lambda r: (r.conv_id, r.at, r.place))
    assert [(r.conv_id, r.edit, r.fault, r.role, r.text, r.cost) for r in got] == [
        (1, "K", None, "user", "Hello.", 0), (1, "D", "duplicate", "user", "Hello.", 4),
        (1, "K", "truncated", "assistant", "so", 3), (2, "D", "blank", " ", " ", 4)]
    assert conversations.repair_edits(df.where("false")).count() == 0
    assert conversations.repair_digest(df.where("false")).count() == 0
    other = spark.createDataFrame([("a", 1, "user", "Hi!"), ("b", 2, "system", "x.")],
                                  SCHEMA.replace("conv_id long", "conv_id string"))
    assert {r.conv_id for r in conversations.repair_digest(other).collect()} == {"a", "b"}
