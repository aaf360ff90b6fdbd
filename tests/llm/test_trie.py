"""The prefix trie against a plain one, over chunks, chains and copies."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from weftline.llm import queries, trie

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{role}\n{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:] if rebuild else turns
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {k: [] for k in members}
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    ending = {k: ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k)))) for k, m in members.items()}
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ending[k].encode()).hexdigest()) for k, m in members.items()), key=repr
    )


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(df):
    return trie.trie(trie.rebuilt(trie.ordered_turns(df)), df)


def made(seed, conversations, most, texts):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "user", "assistant"]), rng.choice(texts)) for c in range(conversations) for t in range(rng.randrange(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_shared_beginnings(spark, seed):
    rows = made(seed, 150, 12, ["a", "é", "long text", ""])
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert got(run(df)) == brute(rows)


def test_copies_and_a_conversation_over_many_chunks(spark, monkeypatch):
    """Copies of one long conversation: their rows, their path and the ids that end with it stand over several ranges."""
    monkeypatch.setattr(trie, "BLOCK_IDS", 3)
    rows = [(1, t, "user", f"t{t}") for t in range(400)] + [(2, t, "user", f"t{t}") for t in range(300)]
    rows += [(c, t, "user", f"t{t}") for c in range(10, 60) for t in range(3)] + [(c, 0, "user", "t0") for c in range(60, 70)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    turns = trie.as_turns(trie.ordered_turns(df))
    assert trie.prefixes(turns).where("conv_id = 1").select("chunk").distinct().count() > 1
    assert got(trie.trie(turns, df)) == brute(rows, rebuild=False)
    assert got(run(df)) == brute(rows)


def test_rounds_are_few(spark, monkeypatch):
    """A complete binary tree of depth 6: as many light levels as its depth; a comb: one."""
    rows = [(c, d, "user", str(c >> d & 1)) for c in range(64) for d in range(6)]
    comb = [(c, d, "user", "on" if d < c else "off") for c in range(40) for d in range(c + 1)]
    for case in (rows, comb):
        df = spark.createDataFrame(case, ROWS)
        assert got(trie.trie(trie.as_turns(trie.ordered_turns(df)), df)) == brute(case, rebuild=False)


def test_odd_rows(spark):
    gone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [
        (None, 1, "user", "lost"), (1000, None, None, None), (1000, 1, "user", "x" * 300_000), (1000, 1, "user", "x" * 300_000), (gone + 2000 - gone % 5, 0, "user", "a"),
        (gone, 0, "user", "none is left"), (-7, 2, "a\nb", "c"), (-8, 2, "a", "b\nc"), (-5, 2, "a", "b\nc"),
    ]
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], ROWS + ", depth int, said string, chunk int")
    want = brute(rows)
    assert got(run(df)) == want and any(r[1] == 0 and r[3] == 6 for r in want)
    assert run(df.limit(0)).count() == 0


def test_sql_of_odd_rows(spark, tmp_path, duck):
    rows = [(None, 1, "user", "lost"), (30, None, None, None), (30, 1, "user", None), *made(3, 40, 10, ["a", "b"])]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    sql = queries.SQL["op13_prefix_trie"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got(queries.op13_prefix_trie(spark, str(tmp_path))) == sorted(duck.execute(sql).fetchall(), key=repr) == brute(rows)
