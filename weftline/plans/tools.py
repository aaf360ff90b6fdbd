"""Registered queries over tool calls, their lint, graphs and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import similarity, text, toolcalls
from weftline.operators import blocks, datasets, graphs, linting, selection
from weftline.plans.inputs import inputs
from weftline.plans.registry import query
from weftline.session import table
from weftline.sources import readers
from weftline.streaming import events as streams

_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_AT = ", ".join(_KEYS)


def _lines(spark, sf, **columns):
    return table(spark, sf, "lineitem").select(*_KEYS, *[c.alias(n) for n, c in columns.items()])


def _int(column):
    return F.col(column).cast("int")


# --- arguments of calls ----------------------------------------------------------------------------------------------

# Of every line, arguments of its columns against others of other columns: a number, a string, an object, and one that may lack.
_LETTER = "CASE l_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'R' ELSE 'N' END"
_SIDES = f"""SELECT {_AT}, l_quantity = l_partkey % 50 AS q, upper(l_returnflag) = upper({_LETTER}) AS f, l_returnflag = {_LETTER} AS same_f, l_linenumber = l_suppkey % 7 AS a,
  l_partkey % 3 > 0 AS s, l_suppkey % 4 > 0 AS other FROM {{lineitem}}"""


def _argument_pairs(spark, sf):
    said = lambda q, f, a, s: F.to_json(F.struct(q.cast("double").alias("q"), f.alias("f"), F.struct(a.cast("int").alias("a"), F.col("l_tax").alias("b")).alias("d"), s.alias("s")))
    part, supp, status = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linestatus")
    expected = said(F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linenumber"), F.when(part % 3 > 0, status))
    predicted = said(part % 50, F.expr(_LETTER), supp % 7, F.when(supp % 4 > 0, status))
    return _lines(spark, sf, a=expected, b=predicted)


@query(f"""
SELECT {_AT}, (CAST(q AS INT) + CAST(f AS INT) + (1 + CAST(a AS INT)) / 2.0 + CAST(s AND other AS INT)) / (3 + CAST(s OR other AS INT)) AS similarity FROM ({_SIDES})""")
def argument_similarities(spark, sf):
    """Strings of one letter are as similar as they are equal, in either case."""
    return _argument_pairs(spark, sf).select(*_KEYS, similarity.argument_similarity("a", "b").alias("similarity"))


@query(f"""
SELECT {_AT}, c AS correct, t AS total, c / t AS accuracy FROM (SELECT *, CAST(CAST(q AS INT) + CAST(same_f AS INT) + CAST(a AS INT) + CAST(s AND other AS INT) AS BIGINT) AS c, CAST(3 + CAST(s AS INT) AS BIGINT) AS t FROM ({_SIDES}))""")
def argument_accuracies(spark, sf):
    return _argument_pairs(spark, sf).select(*_KEYS, similarity.parameter_accuracy("a", "b").alias("r")).select(*_KEYS, "r.*")


@query(f"""
SELECT {_AT}, CASE l_linenumber % 3 WHEN 0 THEN '{{"a": "x y", "n": ' || l_linenumber || '}}' ELSE '{{}}' END AS clean FROM {{lineitem}}""")
def cleaned_arguments(spark, sf):
    k = F.col("l_linenumber") % 3
    raw = F.when(k == 0, F.format_string('{"a": "x\ty", "n": %d}', _int("l_linenumber"))).when(k == 1, "[1, 2]").otherwise("{bad")
    return _lines(spark, sf, raw=raw).select(*_KEYS, text.clean_arguments(F.col("raw")).alias("clean"))


@query(f"""
SELECT {_AT}, CASE l_linenumber % 5 WHEN 3 THEN '' WHEN 2 THEN 'f' || l_suppkey || '|g' WHEN 4 THEN '' ELSE 'f' || l_suppkey END AS names,
  CASE l_linenumber % 5 WHEN 0 THEN 'Hi  bye' WHEN 1 THEN 'x  y' WHEN 2 THEN '' WHEN 3 THEN 'no call' ELSE '[TOOL_CALLS][bad' END AS content FROM {{lineitem}}""")
def calls_in_texts(spark, sf):
    k, n = F.col("l_linenumber") % 5, _int("l_suppkey")
    raw = (
        F.when(k == 0, F.format_string('Hi [TOOL_CALLS][{"name": "f%d", "arguments": {"a": "]"}}] bye', n))
        .when(k == 1, F.format_string('x <tool_call>{"name": "f%d"}</tool_call> y', n))
        .when(k == 2, F.format_string('[TOOL_CALLS]f%d{"a": "}"} g {"b": 1}', n))
        .when(k == 3, "no call")
        .otherwise("[TOOL_CALLS][bad")
    )
    found = _lines(spark, sf, p=toolcalls.parse_inline_calls(raw))
    return found.select(*_KEYS, F.array_join(F.transform("p.calls", lambda c: c["name"]), "|").alias("names"), "p.content")


@query(f"""
SELECT {_AT}, CASE l_linenumber % 3 WHEN 0 THEN ':f' || l_suppkey || ':{{"a":1}}' WHEN 1 THEN l_partkey || ':g:{{}}' ELSE '' END AS calls FROM {{lineitem}}""")
def stored_tool_calls(spark, sf):
    k = F.col("l_linenumber") % 3
    raw = F.when(k == 0, F.format_string('[{"name": "f%d", "arguments": {"a": 1}}, {"id": "8"}]', _int("l_suppkey")))
    raw = raw.when(k == 1, F.format_string('[{"id": "%d", "function": {"name": "g", "arguments": "{}"}}]', _int("l_partkey"))).otherwise("bad")
    shown = F.transform(toolcalls.stored_calls(F.col("raw")), lambda c: F.concat_ws(":", c["id"], c["name"], c["arguments"]))
    return _lines(spark, sf, raw=raw).select(*_KEYS, F.array_join(shown, ",").alias("calls"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '{"x": {"type": "' || p_brand || '"}, "y": [{"type": "' || p_brand || '"}]}' WHEN 1 THEN '{"$ref": "#/elsewhere/e"}' END AS schema FROM {part}""")
def resolved_schemas(spark, sf):
    ref = '{"$ref": "#/shared_entities/e"}'
    schema = F.when(F.col("p_size") % 3 == 0, f'{{"x": {ref}, "y": [{ref}]}}').when(F.col("p_size") % 3 == 1, '{"$ref": "#/elsewhere/e"}').otherwise("{bad")
    rows = table(spark, sf, "part").select("p_partkey", schema.alias("s"), F.format_string('{"e": {"type": "%s"}}', "p_brand").alias("e"))
    return rows.select("p_partkey", toolcalls.resolve_references("s", "e").alias("schema"))


@query(f"""
SELECT {_AT}, 'order_id=O-' || o || ',id=' || l_suppkey || ',Seat_No=' || l_linenumber AS keyed, 'O-' || o || ',P-' || p AS harvested,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 1.0 ELSE 0.5 END AS propagated FROM (SELECT *, l_orderkey + 1000 AS o, l_partkey + 1000 AS p FROM {{lineitem}})""")
def ids_in_results(spark, sf):
    """Ids of a tool's answer, by key and by form, and the share of them that a model's next arguments use."""
    order, part = F.format_string("O-%d", (_int("l_orderkey") + 1000).cast("int")), F.format_string("P-%d", (_int("l_partkey") + 1000).cast("int"))
    answer = F.format_string('{"order_id": "%s", "id": "%d", "Seat_No": "%d", "note": "no id-at all", "part": ["%s"]}', order, _int("l_suppkey"), _int("l_linenumber"), part)
    k, both = F.col("l_linenumber") % 3, F.concat_ws(" ", order, part)
    rows = _lines(spark, sf, answer=answer, reference=F.when(k == 0, "none").otherwise(both), model=F.when(k == 1, both).otherwise(order))
    ids = linting.harvested_ids(F.col("answer"))
    keyed = F.array_join(F.transform(linting.keyed_ids(F.col("answer")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return rows.select(*_KEYS, keyed.alias("keyed"), F.array_join(ids, ",").alias("harvested"), linting.id_propagation(ids, F.col("reference"), F.col("model")).alias("propagated"))


# --- lint ------------------------------------------------------------------------------------------------------------

# Each order is a conversation of a user message, an assistant message that calls one function per line, and one tool
# message per line; its first line's call is answered under another id where the order's number is even.
_CALLED = "SELECT l_orderkey AS k, l_linenumber AS n, min(concat(l_returnflag, l_linestatus)) AS name, min(l_partkey) AS part FROM {lineitem} GROUP BY 1, 2"


def _transcripts(spark, sf):
    calls = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    calls = calls.agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("name"), F.min("l_partkey").alias("part"))
    none, call = F.lit(None), "array<struct<id:string,name:string,arguments:string>>"
    ident = F.concat_ws("-", F.col("k").cast("string"), F.col("n").cast("string"))
    arguments = F.when(F.col("part") % 5 == 0, "{bad").otherwise('{"a": 1}')
    row = lambda ordinal, role, content, made, answered: [
        F.col("k").cast("long").alias("conversation_id"), ordinal.cast("int").alias("ordinal"), F.lit(role).alias("role"), content.cast("string").alias("content"),
        made.cast(call).alias("tool_calls"), answered.cast("string").alias("tool_call_id"),
    ]
    orders = calls.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", ident.alias("id"), "name", arguments.alias("arguments")))).alias("made"))
    made = F.transform("made", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments")))
    asked = orders.select(*row(F.lit(0), "user", F.when(F.col("k") % 3 == 0, "Encik, tak").otherwise("hello"), none, none))
    called = orders.select(*row(F.lit(1), "assistant", F.lit(""), made, none))
    content = F.when(F.col("part") % 4 == 0, '{"error": {"http_status": 500}}').when(F.col("part") % 4 == 1, "no json").otherwise('{"ok": true}')
    told = calls.select(*row(F.col("n") + 1, "tool", content, none, F.when((F.col("k") % 2 == 0) & (F.col("n") == 1), "other").otherwise(ident)))
    return asked.unionByName(called).unionByName(told)


@query(f"""
WITH c AS ({_CALLED}), o AS (SELECT k, count(DISTINCT name) AS names FROM c GROUP BY 1),
r AS (SELECT k, 'unknown_function' AS rule, name AS detail FROM c WHERE name NOT IN ('NO', 'RF')
  UNION ALL SELECT k, 'arguments_not_json', name FROM c WHERE part % 5 = 0
  UNION ALL SELECT k, 'content_not_json', NULL FROM c WHERE part % 4 = 1
  UNION ALL SELECT k, 'unpaired_result', 'other' FROM c WHERE k % 2 = 0 AND n = 1
  UNION ALL SELECT k, 'no_vocative', NULL FROM o WHERE k % 3 <> 0
  UNION ALL SELECT k, 'user_turns', '1' FROM o
  UNION ALL SELECT k, 'few_functions', CAST(names AS VARCHAR) FROM o WHERE names < 2
  UNION ALL SELECT k, 'forbidden', 'tak' FROM o WHERE k % 3 = 0)
SELECT CAST(k AS BIGINT) AS conversation_id, rule, detail FROM r""")
def transcript_lint(spark, sf):
    library = spark.createDataFrame([("NO",), ("RF",)], "name string")
    return linting.lint_transcripts(_transcripts(spark, sf), library, ("tak",), (2, 20), 2)


@query(f"""
WITH c AS ({_CALLED}), f AS (SELECT k, count(DISTINCT name) AS n FROM c GROUP BY 1)
SELECT CAST(k AS BIGINT) AS conversation_id, CAST(1 AS BIGINT) AS user_turns, CAST(count(*) AS INTEGER) AS max_parallel, count(*) FILTER (WHERE part % 4 = 0) AS api_errors,
  string_agg(DISTINCT name, ',' ORDER BY name) AS functions FROM c GROUP BY k""")
def transcript_counters(spark, sf):
    found = linting.transcript_metadata(_transcripts(spark, sf))
    return found.withColumn("functions", F.array_join("functions", ","))


@query(f"SELECT CAST(k AS BIGINT) AS conversation_id, n + 1 AS ordinal FROM ({_CALLED}) c WHERE k % 2 = 0 AND n = 1")
def results_without_calls(spark, sf):
    return linting.unpaired_results(_transcripts(spark, sf)).select("conversation_id", "ordinal")


@query("""
WITH f AS (SELECT p_brand AS library, CASE WHEN p_size % 5 = 0 THEN 'same' ELSE 'f' || p_partkey END AS name, p_size, p_partkey FROM {part}),
n AS (SELECT library, count(*) AS n FROM f GROUP BY 1)
SELECT library, 'function_count' AS rule, CAST(n AS VARCHAR) AS detail FROM n WHERE n NOT BETWEEN 30 AND 50
UNION ALL SELECT library, 'missing_field', name FROM f WHERE p_size % 7 = 0
UNION ALL SELECT library, 'parameters_type', name FROM f WHERE p_partkey % 3 = 0
UNION ALL SELECT library, 'duplicate_name', name FROM f GROUP BY library, name HAVING count(*) > 1
UNION ALL SELECT DISTINCT library, 'dangling_ref', 'e' || (p_size % 4) FROM f WHERE p_size % 4 <> 0 AND p_partkey % 3 <> 0
UNION ALL SELECT library, 'original_lost', 'same' FROM n WHERE library NOT IN (SELECT library FROM f WHERE name = 'same')""")
def library_lint(spark, sf):
    parts = table(spark, sf, "part")
    name = F.when(F.col("p_size") % 5 == 0, "same").otherwise(F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    parameters = F.when(F.col("p_partkey") % 3 == 0, "{}").otherwise(F.format_string('{"type": "object", "x": "#/shared_entities/e%d/y"}', (F.col("p_size") % 4).cast("int")))
    functions = parts.select(
        F.col("p_brand").alias("library"), name.alias("name"), F.when(F.col("p_size") % 7 != 0, "d").alias("description"),
        F.lit("s").alias("stage"), F.lit("r").alias("returns"), parameters.alias("parameters"),
    )
    libraries = functions.select("library").distinct()
    return linting.lint_library(functions, libraries.withColumn("name", F.lit("same")), libraries.withColumn("key", F.lit("e0")))


# --- graphs ----------------------------------------------------------------------------------------------------------

_NODES = """SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_nationkey < 3 THEN 'start' ELSE 'intent' END AS kind, c_custkey AS place FROM {customer}
  UNION ALL SELECT CAST(c_nationkey + 1 AS BIGINT), 'end', c_custkey + 100000000 FROM {customer}"""


def _graph(spark, sf):
    c = table(spark, sf, "customer")
    kind = F.when(F.col("c_nationkey") < 3, "start").otherwise("intent")
    first = c.select(F.col("c_custkey").cast("long").alias("id"), kind.alias("kind"), F.col("c_custkey").cast("long").alias("place"))
    nodes = first.unionByName(c.select((F.col("c_nationkey") + 1).cast("long").alias("id"), F.lit("end").alias("kind"), (F.col("c_custkey") + 100_000_000).cast("long").alias("place")))
    return graphs.clean_graph(nodes, inputs(spark, sf, "edges").withColumn("target", F.col("target") + 2))


@query(f"""
WITH n AS ({_NODES}), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS i FROM n),
s AS (SELECT min(place) AS p FROM f WHERE i = 1 AND kind = 'start')
SELECT id, CASE WHEN kind = 'start' AND place > p THEN 'intent' ELSE kind END AS kind FROM f, s WHERE i = 1""")
def graph_nodes(spark, sf):
    return _graph(spark, sf)[0].select("id", "kind")


@query(f"""
WITH n AS ({_NODES}) SELECT source, target + 2 AS target, place FROM {{edges}} e WHERE source IN (SELECT id FROM n) AND target + 2 IN (SELECT id FROM n)""")
def graph_edges(spark, sf):
    return _graph(spark, sf)[1].select("source", "target", "place")


_DAG = """n AS (SELECT CAST(c_custkey + 1 AS BIGINT) AS id FROM {customer} UNION ALL SELECT CAST(-n_nationkey - 1 AS BIGINT) FROM {nation}),
e AS (SELECT id AS source, id * 2 AS target FROM n WHERE id > 0 UNION ALL SELECT id, id * 3 FROM n WHERE id > 0 UNION ALL SELECT id, id * 2 + 1 FROM n WHERE id > 0 AND id % 3 = 0
  UNION ALL SELECT CAST(-n_nationkey - 1 AS BIGINT), CAST(-((n_nationkey + 1) % 25) - 1 AS BIGINT) FROM {nation} UNION ALL SELECT CAST(-n_nationkey - 1 AS BIGINT), CAST(8 * (n_nationkey + 1) AS BIGINT) FROM {nation})"""


def _dag(spark, sf, part):
    text = "WITH " + _DAG + f" SELECT * FROM {part}"
    for name in ("customer", "nation"):
        text = text.replace("{" + name + "}", f"parquet.`{sf}/{name}.parquet`")
    return spark.sql(text)


@query(f"""
WITH RECURSIVE {_DAG},
f AS (SELECT source, target FROM e WHERE target IN (SELECT id FROM n)),
w(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT f.target, depth + 1 FROM w JOIN f ON f.source = w.id),
m AS (SELECT id, max(depth) AS depth FROM w GROUP BY id),
d AS (SELECT id, coalesce(depth, (SELECT max(depth) + 1 FROM m)) AS depth FROM n LEFT JOIN m USING (id))
SELECT id, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY depth ORDER BY id) - 1 AS INTEGER) AS place FROM d""")
def graph_layers(spark, sf):
    """Many paths lead to most customers; a circle of nations leads to some of them, and nothing to it."""
    return graphs.layers(_dag(spark, sf, "n"), _dag(spark, sf, "e"), 1)


_CHOICES = "SELECT CAST(l_suppkey AS BIGINT) AS walk, CAST(l_linenumber - 1 AS INTEGER) AS step, min(CASE l_partkey % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'retry' WHEN 2 THEN 'odd' END) AS label FROM {lineitem} GROUP BY 1, 2"


@query(f"""
WITH RECURSIVE c AS ({_CHOICES}),
w AS (
  SELECT CAST(s_suppkey AS BIGINT) AS walk, 0 AS step, CAST(s_nationkey AS BIGINT) AS node, [CAST(s_nationkey AS BIGINT)] AS path, 1 AS attempt, '' AS label, '' AS reason, CAST(0 AS BIGINT) AS target, 0 AS done FROM {{supplier}}
  UNION ALL
  SELECT walk, step + done, CASE WHEN done = 1 THEN target ELSE node END, CASE WHEN done = 1 THEN list_append(path, target) ELSE path END, attempt, label, CASE WHEN done = 1 THEN '' WHEN reason <> 'end' AND visit > 4 THEN 'guard' WHEN reason <> 'end' AND step = 14 THEN 'steps' ELSE reason END, target,
    1 - done FROM (
    SELECT *, len(list_filter(path, lambda x: x = target)) + 1 AS visit FROM (
      SELECT walk, step, node, path, done, CASE WHEN done = 1 THEN '' ELSE CASE WHEN r = 'end' THEN NULL WHEN r = 'exhausted' THEN 'Exhausted' WHEN r = 'chosen' THEN asked ELSE 'go' END END AS label,
        CASE WHEN done = 1 THEN reason ELSE r END AS reason, a AS attempt,
        CASE WHEN done = 1 THEN t WHEN r = 'exhausted' THEN 24 WHEN r = 'chosen' AND asked = 'retry' THEN (node + 1) % 25 ELSE (node * 7 + 3) % 25 END AS target FROM (
        SELECT *, CASE WHEN node = 24 THEN 'end' WHEN node % 3 <> 0 THEN 'first' WHEN node % 4 > 0 AND a > node % 4 AND node % 2 = 0 THEN 'exhausted' WHEN asked IS NULL THEN 'unchosen' WHEN asked IN ('go', 'retry') THEN 'chosen' ELSE 'unknown' END AS r FROM (
          SELECT w.walk, w.step, w.node, w.path, w.done, w.reason, w.target AS t, c.label AS asked, len(list_filter(w.path, lambda x: x = w.node)) AS a
          FROM w LEFT JOIN c ON c.walk = w.walk AND c.step = w.step WHERE w.reason NOT IN ('end', 'guard', 'steps')))))
)
SELECT walk, step, node, CAST(attempt AS INTEGER) AS attempt, label, reason FROM w WHERE done = 1""")
def graph_walks(spark, sf):
    """A walk for each supplier from its nation over a graph of all nations, with loops, conditions and limited attempts."""
    k = F.col("n_nationkey").cast("long")
    nations = table(spark, sf, "nation")
    kind = F.when(k == 24, "end").when(k % 3 == 0, "condition").otherwise("intent")
    nodes = nations.select(k.alias("id"), kind.alias("kind"), (k % 4).cast("int").alias("max_attempts"))
    edge = lambda place, target, label: F.struct(F.lit(place).alias("place"), target.cast("long").alias("target"), F.lit(label).alias("label"))
    own = F.filter(F.array(edge(0, (k * 7 + 3) % 25, "go"), edge(1, (k + 1) % 25, "retry"), F.when(k % 2 == 0, edge(2, F.lit(24), "Exhausted"))), F.isnotnull)
    edges = nations.select(k.alias("source"), F.inline(own))
    starts = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("walk"), F.col("s_nationkey").cast("long").alias("node"))
    choices = spark.sql(_CHOICES.replace("{lineitem}", f"parquet.`{sf}/lineitem.parquet`"))
    return graphs.walk(nodes, edges, choices, starts, max_steps=15, max_visits=4)


# --- profiles, versions, events --------------------------------------------------------------------------------------


@query("""
SELECT CASE WHEN n = 0 THEN '0.1.0' ELSE a || '.' || b || '.' || (c + 1) END AS version FROM (SELECT count(*) AS n, max(s_nationkey) AS a,
  arg_max(s_suppkey % 10, s_nationkey * 1000000 + (s_suppkey % 10) * 1000 + s_suppkey % 100) AS b, arg_max(s_suppkey % 100, s_nationkey * 1000000 + (s_suppkey % 10) * 1000 + s_suppkey % 100) AS c FROM {supplier})""")
def next_dataset_version(spark, sf):
    s = table(spark, sf, "supplier")
    version = F.concat_ws(".", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 10).cast("string"), (F.col("s_suppkey") % 100).cast("string"))
    return datasets.next_version(s.select(version.alias("version")).union(spark.range(1).select(F.lit("99.0.x"))))


@query("""
SELECT c_custkey, concat_ws(' ', CASE c_nationkey % 3 WHEN 0 THEN 'Respond in Formal Malay.' WHEN 1 THEN 'Respond in a polite, professional tone with light contractions allowed.' ELSE 'Respond in a casual, conversational Malaysian register.' END,
  CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 3 = 0 THEN 'Do not use English loanwords. Translate all technical terms.' WHEN c_nationkey % 3 = 0 THEN 'Avoid English loanwords unless strictly necessary for technical accuracy.' END) AS guide FROM {customer}""")
def style_guides(spark, sf):
    k = F.col("c_nationkey") % 3
    register = F.when(k == 0, "formal").when(k == 1, "semi-formal").otherwise("colloquial")
    guide = text.style_guide(register, F.when(k == 0, "ms").otherwise("en"), F.lit(False), F.lit(True), F.when(F.col("c_custkey") % 2 == 0, "forbid").otherwise("allowlist"), F.array().cast("array<string>"))
    return table(spark, sf, "customer").select("c_custkey", guide.alias("guide"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 ELSE event_type = 'purchase' END AS retry FROM {events}""")
def retried_errors(spark, sf):
    status = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, 429).otherwise(404))
    message = F.when(F.col("event_type") == "purchase", "Request TIMED OUT").otherwise("no such model")
    return table(spark, sf, "events").select("event_id", text.is_transient_error(status, message).alias("retry"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS key, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'view') AS failed,
  CAST(sum(event_id % 100) AS BIGINT) AS tokens, bool_or(event_type NOT IN ('purchase', 'view')) AS ended FROM {events} GROUP BY 1""")
def live_run_metrics(spark, sf):
    """The batch form of the stream's metrics, from payloads with blanks around them."""
    kind = F.when(F.col("event_type") == "purchase", "item.done").when(F.col("event_type") == "view", "item.error").otherwise("run.done")
    payload = F.format_string(' {"tokens": %d} ', (F.col("event_id") % 100).cast("int"))
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), kind.alias("event"), payload.alias("payload"))
    return streams.live_metrics(streams.well_formed(rows))


@query("""
SELECT CAST(l_orderkey AS BIGINT) AS row_idx, CAST(l_linenumber AS INTEGER) AS turn_num, 'turn.judged' AS event FROM {lineitem} UNION ALL SELECT CAST(o_orderkey AS BIGINT), NULL, 'item.done' FROM {orders}""")
def replayed_events(spark, sf):
    turns = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("row_idx"), F.col("l_linenumber").cast("int").alias("turn_num"))
    items = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("row_idx"), F.lit(None).cast("int").alias("turn_num"))
    return streams.replay(turns.unionByName(items))


@query("""
SELECT p_partkey FROM {part} WHERE p_size % 3 = 0 OR (p_size % 3 = 1 AND p_brand = 'Brand#11')""")
def scoped_parts(spark, sf):
    """Parts that any project may use, and those of one project."""
    projects = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.col("p_brand"), F.lit("x"))).otherwise(F.array(F.lit("y")))
    return selection.scoped(table(spark, sf, "part").withColumn("projects", projects), "projects", "Brand#11").select("p_partkey")


@query("""
SELECT conversation_id, count(*) AS messages, sha256(string_agg(role || ':' || coalesce(content, ''), chr(10) ORDER BY ordinal)) AS digest FROM {messages} m GROUP BY 1""")
def string_row_messages(spark, sf):
    """Messages written as JSON in a string column and parsed again."""
    one = F.struct("ordinal", F.struct("role", "content").alias("m"))
    rows = inputs(spark, sf, "messages").groupBy("conversation_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"])).alias("messages"))
    parsed = readers.parse_string_rows(rows.withColumn("functions", F.lit('[{"name": "f"}, {"name": ""}]')))
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit(""))))
    return parsed.select("conversation_id", F.size("messages").cast("long").alias("messages"), F.sha2(F.array_join(shown, "\n"), 256).alias("digest"))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal DESC) AS i FROM {messages} m)
SELECT conversation_id, string_agg('[' || upper(role) || '] ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY ordinal) AS transcript FROM l WHERE i <= 3 GROUP BY 1""")
def last_three_messages(spark, sf):
    return blocks.transcripts(inputs(spark, sf, "messages"), last=3)


@query("""
SELECT d.doc_id AS conversation_id, l.doc_id IS NULL AS free FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def frozen_split(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("conversation_id"))
    free, held = datasets.split_frozen(ids, table(spark, sf, "labels").select(F.col("doc_id").alias("conversation_id")))
    return free.withColumn("free", F.lit(True)).unionByName(held.withColumn("free", F.lit(False)))
