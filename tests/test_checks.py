"""Language detection, schemas, lints and documents of metrics against plain Python, and on odd rows."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import language
from weftline.operators import graphs, lifecycle, linting, redteam, schemas, scoring, validators
from weftline.session import table
from weftline.sources import readers


# languages


def plain_buckets(text):
    plain = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    s = f" {plain} "
    return [(ord(s[i]) * 6151 + ord(s[i + 1]) * 97 + ord(s[i + 2])) % 8191 for i in range(len(s) - 2)] if plain else []


def test_languages_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    model = language.train(docs)
    counts = {}
    rows = docs.collect()
    for r in rows:
        for b in plain_buckets(r.text):
            own = counts.setdefault(r.language, {})
            own[b] = own.get(b, 0) + 1
    for name, own in counts.items():
        total = sum(own.values()) + 0.5 * 8191
        assert model.weights[name] == pytest.approx([math.log((own.get(b, 0) + 0.5) / total) for b in range(8191)])
    got = {r.doc_id: r for r in validators.with_language(docs, model).collect()}
    for r in rows[:40]:
        logs = {n: sum(w[b] for b in plain_buckets(r.text)) for n, w in model.weights.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[r.doc_id].detected == best
        assert got[r.doc_id].confidence == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()))


def test_languages_of_documents_held_out(spark):
    """Of documents whose id is in no training row, nearly all are told right: 100 % at this scale."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", F.col("lang").alias("language"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.train(language.sampled(docs.where(~held), "doc_id", most=100))
    found = validators.with_language(docs.where(held & (F.length("text") > 20)), model)
    assert found.agg(F.avg((F.col("detected") == F.col("language")).cast("int"))).first()[0] > 0.98


def test_languages_of_odd_texts(spark):
    rows = [("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "kein Training")]
    model = language.train(spark.createDataFrame(rows, "language string, text string"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \n"), (4, "a"), (5, "the the " * 20_000)], "conversation_id long, text string")
    got = {r.conversation_id: (r.detected, r.confidence) for r in validators.with_language(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [(None, None)] * 3 and got[4][0] in ("en", "fr") and got[5] == ("en", 1.0)
    rule = validators.run_validators(validators.with_language(odd, model), primary="en").where("validator = 'langid'")
    assert {r.conversation_id: (r.verdict, r.reason) for r in rule.collect()}[1] == ("warn", "no_detection")
    with pytest.raises(ValueError):
        language.LanguageModel({"en": [0.0]})


# schemas


def plain_kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "integer" if v == int(v) else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def plain_same(a, b):
    numbers = all(plain_kind(x) in ("integer", "number") for x in (a, b))
    return a == b if numbers else json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def plain_breaches(v, s, path=""):
    at = path or "<root>"
    if s is False:
        return [(at, "false_schema")]
    if s is True:
        return []
    kind, out = plain_kind(v), []
    if "type" in s:
        types = s["type"] if isinstance(s["type"], list) else [s["type"]]
        if kind not in types and not (kind == "integer" and "number" in types):
            out.append((at, "type"))
    if "enum" in s and not any(plain_same(v, x) for x in s["enum"]):
        out.append((at, "enum"))
    if "const" in s and not plain_same(v, s["const"]):
        out.append((at, "const"))
    if kind in ("integer", "number"):
        tests = {"minimum": lambda a, b: a < b, "maximum": lambda a, b: a > b, "exclusiveMinimum": lambda a, b: a <= b, "exclusiveMaximum": lambda a, b: a >= b}
        out += [(at, k) for k, f in tests.items() if k in s and f(v, s[k])]
    if kind in ("string", "array"):
        low, high = ("minLength", "maxLength") if kind == "string" else ("minItems", "maxItems")
        out += [(at, low)] * (low in s and len(v) < s[low]) + [(at, high)] * (high in s and len(v) > s[high])
    if kind == "object":
        out += [(at, "required")] * sum(r not in v for r in s.get("required", []))
        if s.get("additionalProperties") is False:
            out += [(at, "additionalProperties")] * sum(k not in s.get("properties", {}) for k in v)
        for k, x in v.items():
            if k in s.get("properties", {}):
                out += plain_breaches(x, s["properties"][k], f"{path}.{k}".lstrip("."))
    if kind == "array" and "items" in s:
        for i, x in enumerate(v):
            out += plain_breaches(x, s["items"], f"{path}.{i}".lstrip("."))
    return out


def random_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 6)
    if kind < 6:
        return rng.choice([None, True, False, rng.randrange(5), 2.5, 3.0, "x", "longer", ""])
    if kind == 6:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: random_value(rng, depth + 1) for k in rng.sample(["a", "b.c", "d[]", "e"], rng.randrange(4))}


def random_schema(rng, depth=0):
    if depth and rng.random() < 0.1:
        return rng.choice([True, False])
    s = {}
    for name, make in {
        "type": lambda: rng.choice(["object", "array", "string", "integer", "number", "null", ["string", "integer"], ["object", "null", "array"]]),
        "enum": lambda: [random_value(rng, 3) for _ in range(3)], "const": lambda: random_value(rng, 3), "minimum": lambda: 2, "maximum": lambda: 2.5,
        "exclusiveMinimum": lambda: 1, "exclusiveMaximum": lambda: 4, "minLength": lambda: 1, "maxLength": lambda: 3, "minItems": lambda: 1, "maxItems": lambda: 2,
        "required": lambda: rng.sample(["a", "b.c", "e"], 2), "additionalProperties": lambda: rng.random() < 0.5,
    }.items():
        if rng.random() < (0.5 if name in ("type", "required") else 0.15):
            s[name] = make()
    if depth < 3:
        s["properties"] = {k: random_schema(rng, depth + 1) for k in rng.sample(["a", "b.c", "d[]", "e"], rng.randrange(5))}
        if rng.random() < 0.6:
            s["items"] = random_schema(rng, depth + 1)
    return s


def test_examples_against_a_plain_walk(spark):
    rng = random.Random(5)
    tools = {t: random_schema(rng) for t in range(25)}
    examples = [(t, i, random_value(rng)) for t in tools for i in range(12)]
    frames = (
        spark.createDataFrame([(t, json.dumps(s)) for t, s in tools.items()], "tool long, parameters string"),
        spark.createDataFrame([(t, i, json.dumps(v)) for t, i, v in examples], "tool long, example long, value string"),
    )
    assert schemas.schema_breaches(frames[0]).count() == 0
    want = sorted((t, i, *b) for t, i, v in examples for b in plain_breaches(v, tools[t]))
    got = sorted((r.tool, r.example, r.path, r.rule) for r in schemas.example_breaches(*frames).collect())
    assert got == want and len({w[3] for w in want}) > 10


def test_odd_schemas_and_examples(spark):
    bad = {1: "[]", 2: None, 3: "{no", 4: '{"type": []}', 5: '{"properties": {"a": {"items": 3}}}', 6: '{"required": ["a", "a"]}', 7: '{"minItems": 1.5, "maximum": "x"}', 8: '{"allOf": [], "additionalProperties": {}}', 9: "{}"}
    tools = spark.createDataFrame(list(bad.items()), "tool long, parameters string")
    got = sorted((r.tool, r.path, r.rule) for r in schemas.schema_breaches(tools).collect())
    assert got == [
        (1, "$", "not_an_object"), (2, "$", "not_an_object"), (3, "$", "not_an_object"), (4, "$", "type"), (5, "$.properties.a.items", "not_a_schema"),
        (6, "$", "required"), (7, "$", "maximum"), (7, "$", "minItems"), (8, "$", "unchecked"), (8, "$", "unchecked"),
    ]
    examples = spark.createDataFrame([(9, 1, None), (9, 2, "{bad"), (9, 3, "1"), (1, 4, "{}"), (99, 5, "{}")], "tool long, example long, value string")
    assert [(r.tool, r.example, r.rule) for r in schemas.example_breaches(tools, examples).collect()] == [(9, 2, "not_json")]
    assert sorted(r.example for r in schemas.valid_examples(tools, examples).collect()) == [1, 3, 4, 5]
    deep = spark.createDataFrame([(9, 1, "[" * 40 + "]" * 40)], "tool long, example long, value string")
    with pytest.raises(ValueError, match="deeper"):
        schemas.example_breaches(tools, deep)


@pytest.mark.parametrize("sent", [0, 50_000])
def test_examples_are_shuffled_once_at_most(spark, sent, monkeypatch):
    """One join by tool, none of all values by path; depth is counted in containers that hold something."""
    monkeypatch.setattr(schemas, "SENT", sent)
    tools = spark.createDataFrame([(1, '{"properties": {"a": {"items": {"type": "integer"}}}}')], "tool long, parameters string")
    at = lambda n, inner: '{"x": "[{\\\\\\"[", "y": ' + "[" * n + inner + "]" * n + "}"
    rows = [(1, 1, '{"a": [1, "x", 2.0, null]}'), (1, 2, at(23, "1")), (1, 3, at(24, ""))]
    found = schemas.example_breaches(tools, spark.createDataFrame(rows, "tool long, example long, value string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted((r.example, r.path, r.rule, r.detail) for r in found.collect()) == [(1, "a.1", "type", "string"), (1, "a.3", "type", "null")]
    with pytest.raises(ValueError, match="deeper"):
        schemas.example_breaches(tools, spark.createDataFrame([(1, 4, at(24, "1"))], "tool long, example long, value string"))


# transcripts

MESSAGE = "conversation_id long, ordinal int, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, payload boolean, agent string, off_topic boolean"


def said(c, i, role, content=None, calls=None, of=None, payload=None, agent=None, off=None):
    return (c, i, role, content, [(k, n, a) for k, n, a in calls] if calls is not None else None, of, payload, agent, off)


DENIED = '{"error": {"http_status": 403}}'


def plain_attempts(rows, forbidden):
    """The machine of each function, message by message."""
    state, owner, out = {}, {}, []
    for c, i, role, content, calls, of, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        if role == "assistant":
            for place, (k, n, _) in enumerate(calls or []):
                if n in forbidden:
                    out.append({"key": (c, i, place, k, n), "outcome": "open", "repeat": state.get((c, n)) == "denied"})
                    owner.setdefault((c, k), out[-1])
        elif role == "tool" and (call := owner.get((c, of))) and call["outcome"] == "open":
            call["outcome"] = "denied" if "403" in (content or "") else "slipped"
            if call["outcome"] == "denied":
                state[(c, call["key"][4])] = "denied"
    return sorted((*x["key"], x["outcome"], x["repeat"]) for x in out)


@pytest.mark.parametrize("seed", range(2))
def test_attempts_against_a_state_machine(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(30):
        ids = []
        for i in range(rng.randrange(1, 14)):
            if rng.random() < 0.5:
                made = [(f"{c}-{i}-{j}", rng.choice(["delete_x", "export_y", "get_z"]), "{}") for j in range(rng.randrange(3))]
                ids += [m[0] for m in made]
                rows.append(said(c, i, "assistant", "", made))
            elif ids:
                rows.append(said(c, i, "tool", rng.choice([DENIED, "{}", None]), of=ids.pop(rng.randrange(len(ids)))))
    functions = spark.createDataFrame([("delete_x", None, "{}"), ("export_y", None, "{}"), ("get_z", None, "{}")], "name string, stage string, parameters string")
    none = spark.createDataFrame([], "conversation_id long, name string")
    df = spark.createDataFrame(rows, MESSAGE)
    found = redteam.attempts(df, functions, none)
    got = sorted((r.conversation_id, r.ordinal, r.place, r.id, r.name, r.outcome, r.repeat) for r in found.collect())
    assert got == plain_attempts(rows, {"delete_x", "export_y"}) and {g[6] for g in got} == {True, False}


def test_red_team_of_odd_conversations(spark, tmp_path):
    rows = [
        said(1, 0, "system", "s"), said(1, 1, "assistant", None), said(2, 0, "user", None), said(2, 3, "user", "x", payload=True), said(2, 5, "assistant", "", []),
        said(3, 0, "tool", "no json", of=None), said(3, 1, "assistant", "", [("a", "delete_x", None), ("a", "delete_x", "{bad")]), said(3, 2, "tool", DENIED, of="a"), said(3, 3, "tool", "{}", of="a"),
    ]
    df = spark.createDataFrame(rows, MESSAGE)
    functions = spark.createDataFrame([("delete_x", "read", '{"required": ["q"]}')], "name string, stage string, parameters string")
    tried = redteam.attempts(df, functions, spark.createDataFrame([(3, "delete_x"), (3, "delete_x")], "conversation_id long, name string"))
    assert sorted((r.place, r.outcome) for r in tried.collect()) == [(0, "denied"), (1, "open")]
    found = redteam.summary(df, tried)
    got = {r.conversation_id: (r.refusal_turns, len(r.attempted), r.n_denied, r.attack_turn_index, r.refused) for r in found.collect()}
    assert got == {1: ([1], 0, 0, 0, True), 2: ([2], 0, 0, 1, True), 3: ([], 2, 1, 0, False)}
    rules = sorted(r.rule for r in redteam.lint(df, functions, tried, spark.createDataFrame([(2,)], "conversation_id long")).collect())
    assert rules == ["arguments_not_json", "content_not_json", "forbidden_call", "forbidden_call", "missing_required", "missing_required", "no_vocative", "unpaired_result"]
    columns = "row_idx long, conversation_id long, domain string, workflow string, shared_entities string, functions string, attack_type string, attack_strategy string, threat_class string, severity string, tone string, target_behavior string"
    scenarios = spark.createDataFrame([(9 - i, i, *["v"] * 10) for i in (3, 2, 7)], columns)
    redteam.write_kept_rows(redteam.kept_rows(scenarios, df, found), str(tmp_path / "rows"))
    files = sorted((tmp_path / "rows").glob("part-*.parquet"))
    kept = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    assert [r.row_idx for r in kept] == [2, 6, 7] and [r.messages == "[]" for r in kept] == [True, False, False] and [r.refused for r in kept] == [None, False, True]
    assert json.loads(kept[1].metadata)["attempted"] == [{"function": "delete_x", "kind": "sensitive"}] * 2
    assert redteam.summary(df.limit(0), tried.limit(0)).count() == 0


def test_extra_lint_of_odd_conversations(spark):
    rows = [
        said(1, 0, "user", None), said(2, 0, "user", "Vanakkam nandri ROMBA", off=True), said(2, 1, "assistant", agent="a"), said(2, 2, "tool", '{"error": {}}'),
        said(2, 3, "assistant", agent="b"), said(2, 4, "assistant"), said(2, 5, "assistant", agent="a"), said(2, 6, "user", "", off=True), said(2, 7, "tool", '{"http_status": 500}'), said(2, 8, "tool", '{"status_code": 404}'),
    ]
    df = spark.createDataFrame(rows, MESSAGE)
    profiles = spark.createDataFrame([(1, "mandarin"), (2, "tamil"), (3, "tamil")], "conversation_id long, profile string")
    got = sorted((r.conversation_id, r.rule, r.found) for r in linting.lint_extra(df, profiles).collect())
    assert got == [(1, "agent_edges", 0), (1, "api_errors", 0), (1, "mandarin", 0), (1, "off_topic", 0)]
    assert sorted((r.source, r.target, r.times) for r in linting.agent_edges(df).collect()) == [("a", "b", 1), ("b", "a", 1)]
    assert linting.lint_extra(df.limit(0), profiles).count() == 0


def test_keyed_ids_are_distinct(spark):
    df = spark.createDataFrame([('{"id": "a", "x": {"id": "a", "order_id": "b"}, "y": {"id": "c"}}',)], "t string")
    assert [tuple(r) for r in df.select(linting.keyed_ids(F.col("t"))).first()[0]] == [("id", "a"), ("order_id", "b"), ("id", "c")]


# scores and runs


def test_failed_requests_miss_every_call(spark):
    call = "row int, place int, name string, arguments string"
    expected = spark.createDataFrame([(1, 0, "f", "{}"), (1, 1, "g", "{}"), (2, 0, "f", "{}")], call)
    predicted = spark.createDataFrame([(1, 0, "f", "{}"), (2, 0, "f", "{}"), (2, 1, "h", "{}")], call)
    failed = spark.createDataFrame([(1,), (1,)], "row int")
    got = sorted((r.row, r.place, r.type, r.func_match, r.api_failed) for r in scoring.match_calls(expected, predicted, ["row"], failed).collect())
    assert got == [(1, 0, "missing", False, True), (1, 1, "missing", False, True), (2, 0, "match", True, False), (2, 1, "extra", False, False)]


def test_metrics_of_nothing_and_of_lone_splits(spark):
    items = spark.createDataFrame([("a", "pass", {"x": 2.0}), (None, None, None)], "split string, verdict string, scores map<string,double>")
    checks = spark.createDataFrame([('b"', "k", "fail", None)], "split string, kind string, verdict string, score double")
    calls = spark.createDataFrame([], "split string, row long, turn long, type string, func_match boolean, correct long, total long, accuracy double, similarity double, api_failed boolean")
    got = json.loads(scoring.metrics_document(items, checks, calls, {"x": 4}, {}).first().document)
    assert list(got) == ["kind", "splits", "overall"] and list(got["splits"]) == ["", "a", 'b"'] and got["overall"]["totalItems"] == 2
    assert got["splits"]["a"] == {"axes": {"x": 0.5}, "validators": {}, "functionCall": None, "verdictCounts": {"pass": 1, "warn": 0, "fail": 0}, "totalItems": 1}
    assert got["splits"]['b"']["validators"] == {"k": {"total": 1, "passRate": 0.0, "warnRate": 0.0, "failRate": 1.0, "meanScore": None}}
    empty = json.loads(scoring.metrics_document(items.limit(0), checks.limit(0), calls, {"x": 4}, {"n": 1}).first().document)
    assert empty["splits"] == {} and empty["overall"]["n"] == 1


# files, libraries, graphs, grids


def test_files_and_libraries_of_odd_kinds(spark):
    files = spark.createDataFrame(
        [("a.html", None, b"<p>Hi<br>you</p>"), ("a.htm", "", b""), ("b.bin", "TEXT/HTML; charset=utf-8", b"<b>x</b>"), ("c.md", None, b" m \r\n"), (None, None, b"x"), ("d.txt", None, None), ("e.txt", None, b"y" * 101)],
        "name string, mime string, content binary",
    )
    got = {r.name: (r.kind, r.status, r.text) for r in readers.file_texts(files, most_bytes=100).collect()}
    assert got == {
        "a.html": ("html", "ok", "Hi\nyou"), "a.htm": ("html", "empty", None), "b.bin": ("html", "ok", "x"), "c.md": ("txt", "ok", "m"), None: (None, "unsupported", None),
        "d.txt": ("txt", "empty", None), "e.txt": ("txt", "too_large", None),
    }
    rows = spark.createDataFrame([(1, None, None, 'q"', None, "3", '[{"role": "user"}]'), (2, "x", "w", None, "{}", None, None), (3, "", "w", "d", "[1]", "[2]", "[1]")], "row_idx long, conversation_id string, workflow string, domain string, shared_entities string, functions string, messages string")
    got = {r.row_idx: (r.conversation_id, json.loads(r.library)) for r in readers.library_pairs(rows).collect()}
    empty = {"shared_entities": {}, "functions": []}
    assert got == {1: ("workflow-1", {"domain": 'q"', "workflow": "", **empty}), 3: ("w-3", {"domain": "d", "workflow": "w", "shared_entities": {}, "functions": [2]})}


def test_graphs_of_odd_documents(spark):
    edge = lambda a, b, **more: {"source": a, "target": b, **more}
    nodes = [{"id": "s", "type": "start"}, {"id": 3, "type": "end"}, {"id": "x", "type": "action", "data": {"toolIds": "t"}}, {"id": "x", "type": "end"}, None, "n"]
    documents = [None, "{bad", "[]", "{}", '{"nodes": 3}', json.dumps({"nodes": nodes, "edges": [edge("s", "x", id="e2"), edge("x", "s"), edge("s", "x", id="e2", label=4), 7, edge("s", None), edge(1, "x")]})]
    df = spark.createDataFrame(list(enumerate(documents)), "graph_id int, document string")
    found, edges, warnings = graphs.coerced(df)
    assert sorted((r.graph_id, r.id, r.kind, r.tools) for r in found.collect()) == [(5, "s", "start", []), (5, "x", "action", [])]
    assert sorted((r.id, r.source, r.target, r.label) for r in edges.collect()) == [("e2", "s", "x", None), ("e2_2", "x", "s", None), ("e2_3", "s", "x", None)]
    got = sorted((r.graph_id, r.warning, r.subject) for r in warnings.collect())
    assert got == [(0, "not_an_object", None), (1, "not_an_object", None), (2, "not_an_object", None), (3, "no_start", None), (4, "no_start", None), (5, "dangling_edge", "s→"), (5, "dangling_edge", "→x"), (5, "duplicate_node", "x"), (5, "invalid_node", None)]



def test_nodes_alone_need_one_parse_and_no_job(spark, monkeypatch):
    """Nodes are computed without edges, without files in between, from one scan; a tool that is asked for twice is there twice."""
    monkeypatch.setattr(graphs, "cut", None)
    monkeypatch.setattr(graphs, "stored", None)
    act = lambda name, tools: {"id": name, "type": "action", "data": {"toolIds": tools}}
    nodes = [{"id": "s", "type": "start"}, act("a", ["t", "u", 3, "t"]), act("b", ["u"]), act("c", []), {"id": "d", "type": "intent", "data": {"toolIds": ["t"]}}, {"id": "a", "type": "start"}, {"id": "z", "type": "start"}]
    df = spark.createDataFrame([(1, json.dumps({"nodes": nodes})), (2, json.dumps({"nodes": nodes[1:5]}))], "graph_id int, document string")
    sound = [(1, 0, "s", "start", []), (1, 4, "d", "intent", []), (1, 6, "z", "intent", [])]
    tools = spark.createDataFrame([("t",), ("t",), (None,), ("x",)], "tool_id string")
    found = graphs.coerced_nodes(df, tools)
    assert sorted(tuple(r) for r in found.collect()) == sorted([*sound, (1, 1, "a", "action", ["t", "t"]), (1, 2, "b", "action", []), (1, 3, "c", "action", [])])
    every = graphs.coerced_nodes(df).collect()
    assert sorted(tuple(r) for r in every) == sorted([*sound, (1, 1, "a", "action", ["t", "u", "3", "t"]), (1, 2, "b", "action", ["u"]), (1, 3, "c", "action", [])])
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("posexplode(try_variant_get") == 1 and final.count("ReusedExchange") == 1


def _edges_by_hand(number, nodes, edges):
    """Edges and dangling edges of a graph, entry by entry."""
    first, taken, kept, dangling = {}, set(), [], []
    for n in nodes:
        if isinstance(n, dict) and isinstance(n.get("id"), str) and n["id"] and n.get("type") in graphs.KINDS:
            first.setdefault(n["id"], n["type"])
    said = lambda x: x if isinstance(x, str) else None
    for place, e in enumerate(edges):
        if "start" not in first.values() or not isinstance(e, dict):
            continue
        source, target = said(e.get("source")), said(e.get("target"))
        if source not in first or target not in first:
            dangling.append((number, f"{source or ''}→{target or ''}"))
            continue
        name = said(e.get("id")) or f"e{place + 1}"
        kept.append((number, place, f"{name}_{place + 1}" if name in taken else name, source, target, said(e.get("label"))))
        taken.add(name)
    return kept, dangling


def test_edges_meet_nodes_without_a_broadcast(spark, tmp_path):
    """Catalyst takes the nodes of documents in files for few; even so their ids don't go through the driver, and rows are those found by hand."""
    one = random.Random(4).choice
    node = lambda: one([7, None, "a", {"id": one(["a", "b", "c", "", 3, None]), "type": one([*graphs.KINDS, "start", "begin", None])}])
    edge = lambda: one([7, None, *[{"id": one(["e1", "e2", "k", "", 5, None]), "source": one(["a", "b", "c", "", 3, None]), "target": one(["a", "b", "q", None]), "label": one(["x", 1, None])}] * 6])
    made = [(i, [node() for _ in range(i % 9)], [edge() for _ in range(i % 7)]) for i in range(300)]
    hub = (300, [{"id": "a", "type": "start"}, *[{"id": f"n{i}", "type": "end"} for i in range(50)]], [{"source": "a", "target": f"n{i % 60}"} for i in range(400)])
    rows = [(i, json.dumps({"nodes": nodes, "edges": edges})) for i, nodes, edges in [*made, hub]]
    spark.createDataFrame(rows, "graph_id int, document string").write.parquet(str(tmp_path / "documents"))
    documents = spark.read.parquet(str(tmp_path / "documents"))
    want = [_edges_by_hand(*graph) for graph in [*made, hub]]
    found, warnings = graphs.coerced_edges(documents), graphs.coerced_warnings(documents)
    ordered = lambda rows: sorted(rows, key=repr)
    assert ordered(tuple(r) for r in found.collect()) == ordered(e for kept, _ in want for e in kept)
    assert ordered((r.graph_id, r.subject) for r in warnings.where("warning = 'dangling_edge'").collect()) == ordered(d for _, dangling in want for d in dangling)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, warnings)]
    assert "Join" not in plans[0] and plans[0].split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert "Broadcast" not in plans[1]


def test_grids_of_odd_runs(spark):
    runs = [(1, None), (2, "{bad"), (3, '{"personaIds": ["a", "b"], "difficulties": [], "samplesPerCell": 0}'), (4, '{"taxonomyNodeIds": ["t"], "samplesPerCell": 2}')]
    got = sorted(((r.run_id, r.place, r.persona, r.topic) for r in lifecycle.replicated(spark.createDataFrame(runs, "run_id int, config string")).collect()), key=repr)
    assert got == [(1, 0, None, None), (2, 0, None, None), (3, 0, "a", None), (3, 1, "b", None), (4, 0, None, "t"), (4, 1, None, "t")]


def test_loanwords_and_lists(spark):
    df = spark.createDataFrame([("Router saya rosak, please HELP fix café ab",), (None,)], "t string")
    assert [r[0] for r in df.select(validators.loanwords(F.col("t"), validators.TELCO_LOANWORDS)).collect()] == [["rosak", "please", "HELP", "fix"], []]
    assert [r[0] for r in df.select(validators.loanwords(F.col("t"), known=())).collect()][0][0] == "Router"
    assert [r[0] for r in spark.createDataFrame([("Yang",), ("the",), (None,)], "w string").select(validators.is_known_malay(F.col("w"))).collect()] == [True, False, False]


def test_attacks_are_computed_once(spark, sf_dir):
    """Lines are read for the targets alone; all else comes from the messages that are stored."""
    from weftline.plans import registry

    plan = registry.QUERIES["redteam_lint"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


def test_lint_computes_its_messages_once(spark):
    call = "array<struct<id:string,name:string,arguments:string>>"
    messages = spark.range(3).selectExpr("id AS conversation_id", "0 AS ordinal", "'user' AS role", "'x' AS content", f"CAST(NULL AS {call}) AS tool_calls", "CAST(NULL AS STRING) AS tool_call_id")
    found = linting.lint_transcripts(messages, spark.createDataFrame([("a",)], "name string"))
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
