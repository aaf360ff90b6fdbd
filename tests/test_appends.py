"""Streams with state and sinks that repetition leaves alone."""

from __future__ import annotations

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.sources import appends
from weftline.streaming import follow


def put(folder, name, rows):
    """A file that comes a second after the one before: streams take files by their times."""
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    at = 1_700_000_000 + len(list(folder.glob("*.json")))
    os.utime(folder / f".{name}", (at, at))
    (folder / f".{name}").rename(folder / name)


def run(spark, stream, sink, checkpoint):
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    query = follow.started(writer, spark)
    assert query.awaitTermination(120)


def event(key, seq, event="e"):
    return {"key": key, "seq": seq, "event": f"{event}{seq}", "payload": "{}"}


def test_replay_then_follow(spark, tmp_path):
    """A batch ends at 3; repeats, late ones and a gap come behind it, over a restart from the checkpoint."""
    past = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0), (None, 9)], "key string, seq long")
    sink = appends.append_once(str(tmp_path / "out"), "follow")
    stream = lambda: follow.follow(spark.readStream.schema(follow.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), past)
    put(tmp_path / "in", "1.json", [event("a", 3), event("a", 5), event("a", 2), event("c", 1), event("b", 1), event(None, 1), event("a", None)])
    run(spark, stream(), sink, tmp_path / "cp")
    put(tmp_path / "in", "2.json", [event("a", 6), event("a", 4), event("a", 5, "again"), event("c", 0), event("b", 1, "again")])
    put(tmp_path / "in", "3.json", [event("a", 7), event("a", 4), event("b", 3)])
    run(spark, stream(), sink, tmp_path / "cp")
    rows = appends.appended(spark, str(tmp_path / "out"), follow.EVENTS).orderBy("batch", "key", "seq").collect()
    got = {k: [(r.seq, r.event) for r in rows if r.key == k] for k in ("a", "b", "c")}
    assert got == {"a": [(4, "e4"), (5, "e5"), (6, "e6"), (7, "e7")], "b": [(1, "e1")], "c": [(0, "e0"), (1, "e1")]}
    assert len(rows) == 7


class State:
    """A value or a map of one key, which counts how often it is asked."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def __getattr__(self, name):
        rows = self.rows
        does = {
            "exists": lambda: bool(rows), "get": lambda: rows[()], "update": lambda value: rows.update({(): value}), "containsKey": lambda k: k in rows,
            "getValue": lambda k: rows[k], "updateValue": lambda k, value: rows.update({k: value}), "removeKey": lambda k: rows.pop(k),
        }[name]
        self.calls += 1
        return does


def followed(chunks):
    """What a key's events come to, call by call, and how often the state was asked."""
    last, held = State(), State()
    handle = type("Handle", (), {"getValueState": lambda *a: last, "getMapState": lambda *a: held})()
    processor = follow._Follow()
    processor.init(handle)
    frames = [[pd.DataFrame(rows, columns=["seq", "event", "payload"]) for rows in chunk] for chunk in chunks]
    out = [tuple(r) for chunk in frames for f in processor.handleInputRows(("k",), iter(chunk), None) for r in f.itertuples(index=False)]
    return out, last.calls + held.calls, held.rows


def test_only_events_behind_a_gap_go_to_the_state():
    rows = [(i, f"e{i}", "{}") for i in range(1000)]
    out, calls, held = followed([[rows[:600], rows[600:]], [rows]])
    assert out == [("k", *r) for r in rows] and not held and calls < 10


@pytest.mark.parametrize("seed", range(20))
def test_of_repeated_events_the_first_counts(seed):
    """In any order, over any batches and calls, some numbers missing: as if each event were looked at by itself."""
    rng = random.Random(seed)
    numbers = [n for n in range(30) if n not in rng.sample(range(12, 60), 6)]
    rows = [(rng.choice(numbers), f"e{i}", None if i % 7 == 0 else "{}") for i in range(90)] if seed % 2 else [(n, f"e{i}", "{}") for i, n in enumerate(rng.sample(numbers * 2, 2 * len(numbers)))]
    cuts = sorted(rng.sample(range(len(rows)), 5))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    out, _, held = followed([parts[:2], parts[2:3], parts[3:]])
    first = {}
    for n, event, payload in rows:
        first.setdefault(n, (event, payload))
    end = next(n for n in range(99) if n not in first)
    assert out == [("k", n, *first[n]) for n in range(end)]
    assert held == {(n,): said for n, said in first.items() if n > end}


@pytest.mark.parametrize("files", [1, 4])
def test_changed_snapshots_of_a_stream_are_those_of_the_batch(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [{"key": rng.choice("xyz"), "seq": i, "snapshot": rng.choice(["p", "q", None])} for i in range(60)]
    for i in range(files):
        put(tmp_path / "in", f"{i}.json", rows[i * 60 // files : (i + 1) * 60 // files])
    schema = "key string, seq long, snapshot string"
    stream = follow.changed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), keep=None)
    run(spark, stream, appends.append_once(str(tmp_path / "out"), "changed"), tmp_path / "cp")
    got = appends.appended(spark, str(tmp_path / "out"), schema).select("key", "seq", "snapshot").collect()
    want, last = [], {}
    for r in rows:
        if r["key"] not in last or last[r["key"]] != r["snapshot"]:
            want.append((r["key"], r["seq"], r["snapshot"]))
        last[r["key"]] = r["snapshot"]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_batch_that_is_repeated_is_there_once(spark, tmp_path):
    """The first try of a batch dies after its write; the restart writes it again."""
    once = appends.append_once(str(tmp_path / "out"), "q", "json")
    tries = []

    def dies(rows, batch):
        once(rows, batch)
        tries.append(batch)
        if len(tries) == 1:
            raise RuntimeError("lost")

    put(tmp_path / "in", "1.json", [event("a", i) for i in range(5)])
    stream = lambda: spark.readStream.schema(follow.EVENTS).json(str(tmp_path / "in"))
    writer = stream().writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    with pytest.raises(Exception, match="lost"):
        writer.start().awaitTermination(120)
    run(spark, stream(), dies, tmp_path / "cp")
    assert tries == [0, 0] and sorted(r.seq for r in appends.appended(spark, str(tmp_path / "out"), follow.EVENTS, "json").collect()) == list(range(5))
    assert appends.appended(spark, str(tmp_path / "nowhere"), follow.EVENTS).count() == 0


def test_a_batch_without_its_end_is_not_read_and_logs_never_fail(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "e", "{}")], follow.EVENTS)
    appends.append_batch(rows, str(tmp_path), "q", 0)
    appends.append_batch(rows, str(tmp_path), "q", 1)
    (tmp_path / "query=q" / "batch=1" / "_SUCCESS").unlink()
    assert [r.batch for r in appends.appended(spark, str(tmp_path), follow.EVENTS).collect()] == [0]
    broken = rows.withColumn("seq", F.raise_error(F.lit("no")).cast("long"))
    appends.append_once(str(tmp_path), "audit", never_fails=True)(broken, 2)
    with pytest.raises(Exception, match="no"):
        appends.append_once(str(tmp_path), "audit")(broken, 2)


def test_several_tables_show_together(spark, tmp_path):
    commits = appends.Commits(spark, str(tmp_path))
    conversations = spark.createDataFrame([(1, 7, 10), (2, 7, None), (3, 8, 5)], "conversation_id long, run_id long, tokens long")
    messages = spark.createDataFrame([(1, 0, "user", "x")], appends.MESSAGE)
    checks = spark.createDataFrame([(1, "schema", "c", "pass", 1.0), (3, "schema", "c", "fail", None), (3, "langid", "l", "pass", None)], appends.VALIDATION)
    assert commits.read("messages", appends.MESSAGE).count() == 0 and appends.run_counters(commits).count() == 0
    first = appends.persist(commits, conversations, messages, checks, "job 1")
    assert appends.persist(commits, conversations, messages, checks, "job 1") == first == 1
    # A fault between two writes: of neither is anything seen.
    with pytest.raises(Exception, match="lost"):
        commits.commit({"conversations": conversations.select("conversation_id", "run_id", F.lit("accepted").alias("status"), "tokens"), "messages": messages.withColumn("role", F.raise_error(F.lit("lost")))})
    assert commits.read("conversations", appends.CONVERSATION).count() == 3 and commits.read("messages", appends.MESSAGE).count() == 1
    assert appends.persist(commits, conversations.where("conversation_id = 2"), messages.limit(0), checks.limit(0)) == 2
    counted = lambda upto=None: sorted(map(tuple, appends.run_counters(commits, upto).collect()))
    assert counted() == [(7, 3, 3, 10), (8, 1, 0, 5)] and counted(1) == [(7, 2, 2, 10), (8, 1, 0, 5)]
    # A number that another writer has taken meanwhile is passed over.
    commits._numbers = lambda: [1]
    assert commits.commit({"messages": messages}) == 3
