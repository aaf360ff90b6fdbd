"""Repair of conversations against a plain search for the best edits, whole and in parts."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from weftline.llm import queries, repair

ROWS = "conv_id long, turn long, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        key = hashlib.md5(f"{role}\n{text}".encode()).hexdigest()
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, key, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """rows of one conversation, in order: (turn, role, text)."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ".")
        seen.add((role, text))
    # best[state]: (cost, edits, lines) from row i on; a fixed number of insertions in a row is enough.
    best = {q: min([(0, "", ()) if q in ("", "a") else (1 << 40, "", ())]) for q in NEXT}

    def insert(best):
        for _ in range(4):
            best = {q: min([b, *((5 + best[to][0], "I" + best[to][1], (NAMES[o] + ":", *best[to][2])) for o, to in NEXT[q].items() if o in NAMES)]) for q, b in best.items()}
        return best

    best = insert(best)
    for (_, role, text), fault in zip(rows[::-1], faults[::-1], strict=True):
        now = {}
        for q in NEXT:
            ways = [(2 + best[q][0], "D" + best[q][1], best[q][2])]
            if fault not in "bd":
                more = 5 * (fault == "t")
                for o, to in NEXT[q].items():
                    c, a, t = best[to]
                    if role[:1] == o:
                        ways.append((more + c, "K" + a, (f"{role}:{text}", *t)))
                    if o in NAMES:
                        ways.append((1 + more + c, "R" + a, (f"{NAMES[o]}:{text}", *t)))
            now[q] = min(ways)
        best = insert(now)
    cost, audit, lines = best[""]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute(rows):
    found = {r[0]: [] for r in rows}
    nulls_first = lambda x: (x is not None, x or 0)
    for conv, turn, _, role, text in sorted(plain_damage(rows), key=lambda r: (nulls_first(r[0]), nulls_first(r[1]), r[2])):
        found[conv].append((turn, role, text))
    return sorted(((c, *plain_repair(r)) for c, r in found.items()), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, n, conversations):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "", " \t", "What?", "é.", "open end "]
    turns = {}
    rows = []
    for _ in range(n):
        c = rng.choice(conversations)
        turns[c] = turns.get(c, 0) + rng.choice([1, 1, 1, 2])
        text = rng.choice(texts) if rng.random() < 0.5 else f"word {rng.random()}."
        rows.append((c, turns[c], rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "a", ""]), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_best_edits(spark, seed):
    rows = made(seed, 300, list(range(60)))
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert got(repair.repair(repair.damage(df), df)) == brute(rows)


def test_a_conversation_over_many_chunks(spark):
    """One conversation holds nearly all rows, so that it stands over every range."""
    rows = made(7, 900, [5] * 20 + [4, 6])
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    faults = repair.find_faults(repair.damage(df))
    assert faults.where("conv_id = 5").select("chunk").distinct().count() > 2
    assert got(repair.repair(repair.damage(df), df)) == brute(rows)


def test_parts_compose():
    """Any cut of the rows into parts gives the path of the whole."""
    rng = random.Random(3)
    for _ in range(200):
        rows = [(rng.choice("suat"), rng.choice("....tbd")) for _ in range(rng.randrange(1, 25))]
        ((_, cost, audit),) = repair.solve(rows, repair.END, (repair.START,), True)
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        after, found = list(repair.END), []
        for i, part in reversed(list(enumerate(parts))):
            found.insert(0, repair.solve(part, tuple(after), tuple(range(4)), i == len(parts) - 1))
            m = repair.matrix(part)
            after = [min(repair.NEVER, *(m[4 * p + q] + after[q] for q in range(4))) for p in range(4)]
        state, said, total = repair.START, "", 0
        for f in found:
            state, c, a = f[state]
            said, total = said + a, total + c
        assert (said, total) == (audit, cost) and after[repair.START] == cost


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (2, 3, "user", "x" * 300_000 + "."), (2, 4, "assistant", None),
        (3, 1, "", "x."), (4, 7, "user", "b."), (4, 7, "assistant", "c."), (4, 7, "assistant", "c."), (5, 1, "üser", "d!"), (-6, -2, "system", "e."), (-6, 9, "user", "f"),
    ]
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], ROWS + ", chunk int, fault string, extra int")
    assert got(repair.repair(repair.damage(df), df)) == brute(rows)
    assert repair.repair(repair.damage(df.limit(0)), df.limit(0)).count() == 0


def test_ids_of_which_every_row_is_dropped(spark):
    gone = next((c, t) for c in range(100) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "a.")], ROWS)
    assert got(repair.repair(repair.damage(df), df)) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_real_rows_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "cut"), (2, 0, "assistant", "So.")]
    found = {r.conv_id: (r.cost, r.audit) for r in repair.repair(repair.as_is(spark.createDataFrame(rows, ROWS))).collect()}
    assert found == {1: (2, "KKD"), 2: (2, "D")}


def test_sql_of_odd_rows(spark, tmp_path, duck):
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, 2, None, "b"), (2, 1, "user", None), *made(1, 80, list(range(9)))]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    sql = queries.SQL["op12_conversation_repair"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got(queries.op12_conversation_repair(spark, str(tmp_path))) == sorted(duck.execute(sql).fetchall(), key=repr) == brute(rows)
