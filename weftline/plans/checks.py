"""Registered queries over schemas, red-team and agent transcripts, runs' metadata and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graphs, linting, redteam, runs, schemas, scoring, validators
from weftline.plans.registry import query
from weftline.session import stored, table

# --- examples of tools -----------------------------------------------------------------------------------------------


def _tools(spark, sf):
    """A tool for each supplier; of some the schema is unsound."""
    k = F.col("s_nationkey").cast("int")
    schema = F.format_string(
        '{"type": "object", "required": ["quantity", "flag"], "additionalProperties": false, "properties": {"quantity": {"type": "%s", "minimum": %d},'
        ' "flag": {"type": ["string", "null"], "enum": ["A", "R", null]}, "sizes": {"type": "array", "maxItems": 2, "items": {"type": "integer"}}, "other": false}, "pattern": "x"}',
        F.when(k % 10 == 7, "integral").otherwise("integer"), k,
    )
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("tool"), schema.alias("parameters"))


def _examples(spark, sf):
    n = F.col("l_linenumber")
    sizes = F.when(n <= 3, F.transform(F.sequence(F.lit(1), n), lambda x: x.cast("double"))).otherwise(F.array("l_tax"))
    said = F.struct(
        F.when(n > 1, F.col("l_quantity")).alias("quantity"), F.col("l_returnflag").alias("flag"), sizes.alias("sizes"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit(1)).alias("other"), F.when(F.col("l_partkey") % 7 == 0, F.lit(1)).alias("more"),
    )
    value = F.when(F.col("l_partkey") % 11 == 0, "{bad").otherwise(F.to_json(said))
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("tool"), key.alias("example"), value.alias("value"))


@query("""
WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS tool, s_nationkey AS k FROM {supplier} WHERE s_nationkey % 10 <> 7),
x AS (SELECT s.tool, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS example, l.*, k FROM {lineitem} l JOIN s ON s.tool = l.l_suppkey),
g AS (SELECT * FROM x WHERE l_partkey % 11 <> 0)
SELECT tool, example, '<root>' AS path, 'not_json' AS rule FROM x WHERE l_partkey % 11 = 0
UNION ALL SELECT tool, example, '<root>', 'required' FROM g WHERE l_linenumber = 1
UNION ALL SELECT tool, example, 'quantity', 'minimum' FROM g WHERE l_linenumber > 1 AND l_quantity < k
UNION ALL SELECT tool, example, 'quantity', 'type' FROM g WHERE l_linenumber > 1 AND l_quantity <> floor(l_quantity)
UNION ALL SELECT tool, example, 'flag', 'enum' FROM g WHERE l_returnflag NOT IN ('A', 'R')
UNION ALL SELECT tool, example, 'sizes', 'maxItems' FROM g WHERE l_linenumber = 3
UNION ALL SELECT tool, example, 'sizes.0', 'type' FROM g WHERE l_linenumber > 3 AND l_tax <> floor(l_tax)
UNION ALL SELECT tool, example, 'other', 'false_schema' FROM g WHERE l_partkey % 5 = 0
UNION ALL SELECT tool, example, '<root>', 'additionalProperties' FROM g WHERE l_partkey % 7 = 0""")
def tool_example_breaches(spark, sf):
    return schemas.example_breaches(_tools(spark, sf), _examples(spark, sf)).select("tool", "example", "path", "rule")


@query("""
SELECT CAST(s_suppkey AS BIGINT) AS tool, '$' AS path, 'unchecked' AS rule, 'pattern' AS detail FROM {supplier}
UNION ALL SELECT CAST(s_suppkey AS BIGINT), '$.properties.quantity', 'type', '"integral"' FROM {supplier} WHERE s_nationkey % 10 = 7""")
def tool_schema_breaches(spark, sf):
    return schemas.schema_breaches(_tools(spark, sf))


# --- red-team and agents' transcripts --------------------------------------------------------------------------------

_CALLED = "SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber AS n, min(l_returnflag) AS flag, min(l_tax) AS tax, min(l_partkey) AS part FROM {lineitem} GROUP BY 1, 2"
_NAME = "CASE flag WHEN 'A' THEN 'delete_account' WHEN 'R' THEN 'export_rows' ELSE 'get_order' END"
_CALLS = "array<struct<id:string,name:string,arguments:string>>"


def _called(spark, sf):
    return spark.sql(_CALLED.replace("{lineitem}", f"parquet.`{sf}/lineitem.parquet`"))


def _attacks(spark, sf):
    """Each order is a conversation: a user message, a call and a result for each line, a last attack and a last answer."""
    lines = stored(_called(spark, sf), "called").withColumn("name", F.expr(_NAME)).withColumn("id", F.concat_ws("-", "k", "n"))
    none = F.lit(None)
    row = lambda df, ordinal, role, content, calls=none, call=none, payload=none: df.select(
        F.col("k").alias("conversation_id"), ordinal.cast("int").alias("ordinal"), F.lit(role).alias("role"), content.cast("string").alias("content"),
        calls.cast(_CALLS).alias("tool_calls"), call.cast("string").alias("tool_call_id"), payload.cast("boolean").alias("payload"),
    )
    orders = lines.select("k").distinct()
    arguments = F.when(F.col("part") % 5 == 0, "{bad").when(F.col("part") % 5 == 1, "{}").otherwise('{"id": 1}')
    made = F.array(F.struct("id", "name", arguments.alias("arguments")))
    result = F.when((F.col("flag") != "N") & (F.col("tax") > 0), '{"error": {"http_status": 403}}').otherwise('{"ok": true}')
    messages = (
        row(orders, F.lit(0), "user", F.when(F.col("k") % 2 == 0, "hello Puan").otherwise("wah boss"), payload=F.when(F.col("k") % 3 == 0, True))
        .unionAll(row(lines, F.col("n") * 2, "assistant", F.lit(""), made))
        .unionAll(row(lines, F.col("n") * 2 + 1, "tool", result, call=F.col("id")))
        .unionAll(row(orders, F.lit(99), "user", F.lit("now"), payload=F.col("k") % 2 == 0))
        .unionAll(row(orders, F.lit(100), "assistant", F.lit("no")))
    )
    return stored(messages, "attacks")


def _functions(spark):
    listed = [(n, "read", '{"type": "object", "required": ["id"]}') for n in ("delete_account", "export_rows")]
    return spark.createDataFrame(listed, "name string, stage string, parameters string")


def _targets(spark, sf):
    return _called(spark, sf).where("flag = 'N' AND k % 4 = 0").select(F.col("k").alias("conversation_id"), F.lit("get_order").alias("name"))


_TRIED = f"""c AS ({_CALLED}), t AS (SELECT k, n, {_NAME} AS name, CASE flag WHEN 'R' THEN 'exfil' ELSE 'sensitive' END AS kind, flag <> 'N' AND tax > 0 AS denied FROM c WHERE flag <> 'N' OR k % 4 = 0),
r AS (SELECT *, coalesce(bool_or(denied) OVER (PARTITION BY k, name ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again FROM t)"""


@query(f"""
WITH {_TRIED}, s AS (SELECT k, count(*) AS m FROM c GROUP BY 1),
a AS (SELECT k, string_agg(name || ':' || kind, ',' ORDER BY n) AS attempted, count(*) FILTER (WHERE denied) AS n_denied, count(*) FILTER (WHERE NOT denied) AS n_slipped, count(*) FILTER (WHERE again) AS n_repeats FROM r GROUP BY 1)
SELECT k AS conversation_id, CAST(2 * m + 2 AS VARCHAR) AS refusal_turns, coalesce(attempted, '') AS attempted, coalesce(n_denied, 0) AS n_denied, coalesce(n_slipped, 0) AS n_slipped, coalesce(n_repeats, 0) AS n_repeats,
  CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE 2 * m + 1 END AS INTEGER) AS attack_turn_index, attempted IS NULL AS refused FROM s LEFT JOIN a USING (k)""")
def redteam_summaries(spark, sf):
    messages = _attacks(spark, sf)
    found = redteam.summary(messages, redteam.attempts(messages, _functions(spark), _targets(spark, sf)))
    shown = F.array_join(F.transform("attempted", lambda a: F.concat_ws(":", a["function"], a["kind"])), ",")
    return found.withColumns({"attempted": shown, "refusal_turns": F.array_join(F.transform("refusal_turns", lambda i: i.cast("string")), ",")})


@query(f"""
WITH {_TRIED}
SELECT k AS conversation_id, 'unknown_function' AS rule, 'get_order' AS detail FROM c WHERE flag = 'N'
UNION ALL SELECT k, 'arguments_not_json', {_NAME} FROM c WHERE part % 5 = 0
UNION ALL SELECT k, 'missing_required', {_NAME} FROM c WHERE part % 5 < 2 AND flag <> 'N'
UNION ALL SELECT k, 'forbidden_call', kind || ' ' || name FROM t
UNION ALL SELECT DISTINCT k, 'forbidden_word', 'boss' FROM c WHERE k % 2 = 1 AND k % 5 = 0
UNION ALL SELECT DISTINCT k, 'no_vocative', NULL FROM c WHERE k % 2 = 1 AND k % 5 = 0""")
def redteam_lint(spark, sf):
    messages, functions = _attacks(spark, sf), _functions(spark)
    malay = messages.where("conversation_id % 5 = 0").select("conversation_id")
    return redteam.lint(messages, functions, redteam.attempts(messages, functions, _targets(spark, sf)), malay)


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS row_idx, o_orderpriority AS attack_type, o_orderstatus AS severity, o_orderkey IN (SELECT l_orderkey FROM {lineitem}) AS told,
  CASE WHEN o_orderkey IN (SELECT l_orderkey FROM {lineitem}) THEN NOT EXISTS (SELECT 1 FROM (""" + _CALLED + """) c WHERE c.k = o_orderkey AND (flag <> 'N' OR k % 4 = 0)) END AS refused FROM {orders}""")
def redteam_rows(spark, sf):
    messages, o = _attacks(spark, sf), table(spark, sf, "orders")
    found = redteam.summary(messages, redteam.attempts(messages, _functions(spark), _targets(spark, sf)))
    text = lambda name, value: F.lit(value).alias(name)
    scenarios = o.select(
        F.col("o_orderkey").cast("long").alias("row_idx"), F.col("o_orderkey").cast("long").alias("conversation_id"), text("domain", "shop"), text("workflow", "returns"),
        text("shared_entities", "{}"), text("functions", "[]"), F.col("o_orderpriority").alias("attack_type"), text("attack_strategy", "plain"), text("threat_class", "x"),
        F.col("o_orderstatus").alias("severity"), text("tone", "calm"), text("target_behavior", "y"),
    )
    return redteam.kept_rows(scenarios, messages, found).select("row_idx", "attack_type", "severity", (F.col("messages") != "[]").alias("told"), "refused")


_AGENTS = "SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber AS n, min(l_returnflag) AS agent, min(l_linestatus) AS status, min(l_partkey) AS part FROM {lineitem} GROUP BY 1, 2"


def _agents(spark, sf):
    """Lines as messages: even ones of assistants, by agent; one of the others in three from a tool, the rest from users."""
    lines = spark.sql(_AGENTS.replace("{lineitem}", f"parquet.`{sf}/lineitem.parquet`"))
    role = F.when(F.col("n") % 2 == 0, "assistant").when(F.col("part") % 3 == 0, "tool").otherwise("user")
    content = F.when((role == "tool") & (F.col("part") % 2 == 0), '{"error": {"code": 1}}').when(role == "tool", "{}").when(F.col("part") % 5 == 0, "NANDRI, seri").when(F.col("part") % 5 == 1, "வணக்கம் 你好 吗").otherwise("xie xie")
    return lines.select(F.col("k").alias("conversation_id"), F.col("n").cast("int").alias("ordinal"), role.alias("role"), content.alias("content"), F.lit(None).cast(_CALLS).alias("tool_calls"), "agent", (F.col("status") == "F").alias("off_topic"))


@query(f"""
WITH c AS ({_AGENTS}), a AS (SELECT k, lag(agent) OVER (PARTITION BY k ORDER BY n) AS source, agent AS target FROM c WHERE n % 2 = 0)
SELECT k AS conversation_id, source, target, count(*) AS times FROM a WHERE source <> target GROUP BY ALL""")
def agent_transitions(spark, sf):
    return linting.agent_edges(_agents(spark, sf))


@query(f"""
WITH c AS ({_AGENTS}), x AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'assistant' WHEN part % 3 = 0 THEN 'tool' ELSE 'user' END AS role FROM c),
a AS (SELECT k, lag(agent) OVER (PARTITION BY k ORDER BY n) AS source, agent AS target FROM c WHERE n % 2 = 0),
e AS (SELECT k, count(DISTINCT source || target) AS edges FROM a WHERE source <> target GROUP BY 1),
p AS (SELECT k, count(*) FILTER (WHERE role = 'tool' AND part % 2 = 0) AS errors, count(*) FILTER (WHERE role = 'user' AND status = 'F') AS off,
  count(*) FILTER (WHERE role = 'user' AND part % 5 = 0) AS nandri, count(*) FILTER (WHERE role = 'user' AND part % 5 = 1) AS scripts, count(*) FILTER (WHERE role = 'user' AND part % 5 > 1) AS xie FROM x GROUP BY 1)
SELECT k AS conversation_id, 'api_errors' AS rule, errors AS found FROM p WHERE errors < 1
UNION ALL SELECT k, 'off_topic', off FROM p WHERE off < 1
UNION ALL SELECT k, 'agent_edges', coalesce(edges, 0) FROM p LEFT JOIN e USING (k) WHERE coalesce(edges, 0) < 1
UNION ALL SELECT k, 'tamil', n FROM (SELECT k, 2 * least(nandri, 1) + scripts AS n FROM p) WHERE k % 3 = 0 AND n < 3
UNION ALL SELECT k, 'mandarin', n FROM (SELECT k, least(xie, 1) + 2 * scripts AS n FROM p) WHERE k % 3 = 1 AND n < 2""")
def extra_lint(spark, sf):
    """A Tamil word has letters and vowel signs, of which the script's pattern makes one run; a space parts runs of Han."""
    messages = _agents(spark, sf)
    k = F.col("conversation_id")
    profiles = messages.select("conversation_id").distinct().select(k, F.when(k % 3 == 0, "tamil").when(k % 3 == 1, "mandarin").alias("profile"))
    return linting.lint_extra(messages, profiles, {"api_errors": 1, "off_topic": 1, "agent_edges": 1})


# --- runs ------------------------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN [[c_nationkey, 1], [c_nationkey + 1000000, 2], [c_nationkey, 3]] WHEN 1 THEN [[c_nationkey + 1, 1]] WHEN 2 THEN CAST([] AS BIGINT[][]) END AS j FROM {customer}),
j AS (SELECT c_custkey, string_agg(s_name || ':m' || e[2], ',' ORDER BY e[2]) AS judges FROM (SELECT c_custkey, unnest(j) AS e FROM g) JOIN {supplier} s ON s_suppkey = e[1] GROUP BY 1)
SELECT CAST(o_orderkey AS BIGINT) AS run_id, CAST(p_partkey AS BIGINT) AS benchmark_id, p_type AS kind, s.s_name AS candidate,
  CASE WHEN o_orderkey % 3 > 0 THEN 'group ' || o_custkey END AS group_name, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN j.judges END, w.s_name || ':own', '') AS judges,
  CASE o_orderkey % 4 WHEN 0 THEN 'mean' ELSE 'median' END AS consensus_method,
  CASE o_orderkey % 2 WHEN 0 THEN 'r' || n_nationkey END AS rubric_name, CASE WHEN o_orderkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'tone:' || greatest(1, n_nationkey) || ',axis:5' ELSE '' END AS axes
FROM {orders} o JOIN {part} p ON p_partkey = o_orderkey % 1000 JOIN {supplier} s ON s.s_suppkey = o_custkey % 12
LEFT JOIN j ON j.c_custkey = o_custkey LEFT JOIN {supplier} w ON w.s_suppkey = o_orderkey % 15 AND o_orderkey % 5 <> 0 LEFT JOIN {nation} n ON n_nationkey = o_custkey % 25""")
def run_metadata(spark, sf):
    """Judges of a group as a JSON list, as a string that holds one, as an empty list, or as no list; else the run's own judge."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    text = lambda x: x.cast("string")
    judge = lambda key, model: F.struct(text(key).alias("providerCredentialId"), F.lit(model).alias("model"))
    k, nation = F.col("c_custkey") % 4, F.col("c_nationkey")
    listed = F.to_json(F.array(judge(nation, "m1"), judge(nation + 1_000_000, "m2"), judge(nation, "m3"), judge(nation, ""), judge(F.lit(None), "m5")))
    quoted = F.regexp_extract(F.to_json(F.struct(F.to_json(F.array(judge(nation + 1, "m1"))).alias("v"))), r"(?s)^\{.v.:(.*)\}$", 1)
    groups = c.select(F.col("c_custkey").alias("group_id"), F.concat(F.lit("group "), text(F.col("c_custkey"))).alias("name"), F.when(k == 0, F.concat(F.lit("[3, "), F.substring(listed, 2, 10_000))).when(k == 1, quoted).when(k == 2, "[]").otherwise('{"judges": 1}').alias("judges"))
    providers = table(spark, sf, "supplier").select(text(F.col("s_suppkey")).alias("provider_id"), F.col("s_name").alias("name"))
    key, n = F.col("o_orderkey"), F.col("n_nationkey")
    axes = F.when(n % 3 == 0, F.format_string('[{"key": "tone", "scale": %d}, {"label": "x"}]', n.cast("int"))).otherwise("{}")
    rubrics = table(spark, sf, "nation").select(n.alias("rubric_id"), F.concat(F.lit("r"), text(n)).alias("name"), axes.alias("axes"))
    asked = o.select(
        key.cast("long").alias("run_id"), (key % 1000).alias("benchmark_id"), text(F.col("o_custkey") % 12).alias("provider_id"), F.lit("m").alias("model"),
        F.when(key % 3 > 0, F.col("o_custkey")).alias("group_id"), F.when(key % 5 != 0, text(key % 15)).alias("judge_provider_id"), F.lit("own").alias("judge_model"),
        F.when(key % 4 == 0, "mean").when(key % 4 == 1, "").alias("consensus_method"), F.when(key % 2 == 0, F.col("o_custkey") % 25).alias("rubric_id"),
    )
    benchmarks = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("benchmark_id"), F.col("p_type").alias("kind"), F.lit(1).alias("project_id"))
    found = runs.run_metadata(asked, benchmarks, providers, groups, rubrics)
    shown = F.array_join(F.transform("judges", lambda j: F.concat_ws(":", j["name"], j["model"])), ",")
    scales = F.array_join(F.transform("axes", lambda a: F.concat_ws(":", a["key"], a["scale"].cast("string"))), ",")
    return found.select("run_id", "benchmark_id", "kind", "candidate", "group_name", shown.alias("judges"), "consensus_method", "rubric_name", scales.alias("axes"))


_PART = """'{{"axes":' || '{{"accuracy":' || coalesce(CAST(acc AS VARCHAR), 'null') || ',"tone":' || coalesce(CAST(tone AS VARCHAR), 'null') || '}}' || ',"validators":{{' || coalesce(v.doc, '') || '}},"functionCall":' || coalesce(f.doc, 'null')
  || ',"verdictCounts":{{"pass":' || p || ',"warn":' || w || ',"fail":' || x || '}},"totalItems":' || n"""


@query("""
WITH i AS (SELECT coalesce(l_linestatus, '') AS split, CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'warn' ELSE 'pass' END AS verdict, 1.0 + l_partkey % 5 AS acc, CASE WHEN l_linenumber % 3 > 0 THEN 1.0 + l_orderkey % 5 END AS tone FROM {lineitem}),
ia AS (SELECT split, grouping(split) AS o, round(CAST(avg(acc) AS DOUBLE) / 5, 9) AS acc, round(CAST(avg(tone) AS DOUBLE) / 4, 9) AS tone, count(*) FILTER (WHERE verdict = 'pass') AS p, count(*) FILTER (WHERE verdict = 'warn') AS w, count(*) FILTER (WHERE verdict = 'fail') AS x, count(*) AS n FROM i GROUP BY GROUPING SETS ((split), ())),
v0 AS (SELECT o_orderstatus AS split, 'k' || o_custkey % 3 AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN 0.25 * (o_orderkey % 4) END AS score FROM {orders}),
v1 AS (SELECT split, grouping(split) AS o, kind, count(*) AS n, round(avg(CAST(verdict = 'pass' AS INT)), 9) AS p, round(avg(CAST(verdict = 'warn' AS INT)), 9) AS w, round(avg(CAST(verdict = 'fail' AS INT)), 9) AS x, round(CAST(avg(score) AS DOUBLE), 9) AS m FROM v0 GROUP BY GROUPING SETS ((split, kind), (kind))),
v AS (SELECT split, o, string_agg('"' || kind || '":{{"total":' || n || ',"passRate":' || p || ',"warnRate":' || w || ',"failRate":' || x || ',"meanScore":' || coalesce(CAST(m AS VARCHAR), 'null') || '}}', ',' ORDER BY kind) AS doc FROM v1 GROUP BY ALL),
f0 AS (SELECT l_linestatus AS split, l_orderkey AS r, l_orderkey % 3 AS t, (l_partkey % 7 <> 0 AND l_partkey % 11 <> 0 AND l_suppkey % 5 <> 0) AS fm, l_partkey % 7 <> 0 AND l_partkey % 11 <> 0 AND l_linenumber % 4 = 3 AS good, l_linenumber % 4 AS c, 0.25 * (l_linenumber % 5) AS s FROM {lineitem} WHERE l_orderkey % 13 <> 0),
f1 AS (SELECT split, r, t, bool_and(good) AS g, count(*) AS n, count(*) FILTER (WHERE fm) AS fm, sum(c) AS c, 3 * count(*) AS tot, sum(s) AS s FROM f0 GROUP BY ALL),
f AS (SELECT split, grouping(split) AS o, '{{"total_calls":' || CAST(sum(n) AS BIGINT) || ',"total_turns":' || count(*) || ',"total_params":' || CAST(sum(tot) AS BIGINT) || ',"function_accuracy":' || round(CAST(sum(fm) AS DOUBLE) / sum(n), 9) || ',"parameter_accuracy":' || round(CAST(sum(c) AS DOUBLE) / sum(tot), 9)
  || ',"turn_level_parameter_accuracy":' || round(CAST(count(*) FILTER (WHERE g) AS DOUBLE) / count(*), 9) || ',"argument_similarity":' || round(CAST(sum(s) AS DOUBLE) / sum(n), 9) || '}}' AS doc FROM f1 GROUP BY GROUPING SETS ((split), ())),
k AS (SELECT split, o FROM ia UNION SELECT split, o FROM v UNION SELECT split, o FROM f),
d AS (SELECT k.split, k.o, """.replace("{{", "{").replace("}}", "}") + _PART.replace("{{", "{").replace("}}", "}").replace("|| p ||", "|| coalesce(p, 0) ||").replace("|| w ||", "|| coalesce(w, 0) ||").replace("|| x ||", "|| coalesce(x, 0) ||").replace("|| n", "|| coalesce(n, 0)") + """ AS doc
  FROM k LEFT JOIN ia ON ia.split IS NOT DISTINCT FROM k.split AND ia.o = k.o LEFT JOIN v ON v.split IS NOT DISTINCT FROM k.split AND v.o = k.o LEFT JOIN f ON f.split IS NOT DISTINCT FROM k.split AND f.o = k.o)
SELECT '{"kind":"chat-replay","splits":{' || (SELECT string_agg('"' || split || '":' || doc || '}', ',' ORDER BY split) FROM d WHERE o = 0) || '},"overall":' || (SELECT doc FROM d WHERE o = 1) || ',"failedItems":2,"costUsd":0.5}}' AS document""")
def run_metrics_document(spark, sf):
    """Judged lines by status, validations of orders by theirs (a status more), and calls of lines."""
    line, order = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    verdict = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").otherwise("pass")
    tone = F.when(F.col("l_linenumber") % 3 > 0, (1 + F.col("l_orderkey") % 5).cast("double"))
    items = line.select(F.col("l_linestatus").alias("split"), verdict.alias("verdict"), F.create_map(F.lit("accuracy"), (1 + F.col("l_partkey") % 5).cast("double"), F.lit("tone"), tone).alias("scores"))
    key = F.col("o_orderkey")
    validations = order.select(
        F.col("o_orderstatus").alias("split"), F.concat(F.lit("k"), (F.col("o_custkey") % 3).cast("string")).alias("kind"),
        F.when(key % 3 == 0, "pass").when(key % 3 == 1, "warn").otherwise("fail").alias("verdict"), F.when(key % 2 == 0, 0.25 * (key % 4)).alias("score"),
    )
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(part % 7 == 0, "missing").when(part % 11 == 0, "extra").otherwise("match")
    calls = line.select(
        F.col("l_linestatus").alias("split"), F.col("l_orderkey").alias("row"), (F.col("l_orderkey") % 3).alias("turn"), kind.alias("type"), ((kind == "match") & (F.col("l_suppkey") % 5 != 0)).alias("func_match"),
        (n % 4).alias("correct"), F.lit(3).alias("total"), F.when(n % 4 == 3, 1.0).otherwise(0.5).alias("accuracy"), (0.25 * (n % 5)).alias("similarity"), (F.col("l_orderkey") % 13 == 0).alias("api_failed"),
    )
    return scoring.metrics_document(items, validations, calls, {"accuracy": 5, "tone": 4}, {"failedItems": 2, "costUsd": 0.5})


# --- profiles --------------------------------------------------------------------------------------------------------

_FOREIGN = "list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿĀ-ɏ]+'), lambda w: regexp_matches(w, '^[A-Za-z]{3,}$') AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in (*validators.TELCO_LOANWORDS, *validators.MALAY_WORDS)) + "))"


@query(f"""
WITH x AS (SELECT doc_id, doc_id % 3 AS k, {_FOREIGN} AS f, regexp_matches(coalesce(text, ''), '(?i)\\bth[aeiou]\\b') AS banned FROM {{documents}})
SELECT doc_id, 'fail' AS verdict, 'banned_pattern' AS reason FROM x WHERE banned
UNION ALL SELECT doc_id, CASE k WHEN 0 THEN 'fail' ELSE 'warn' END, 'english_loanwords ' || array_to_string(f[1:10], ' ') FROM x WHERE k < 2 AND len(f) > 0
UNION ALL SELECT doc_id, 'pass', NULL FROM x WHERE NOT banned AND NOT (k < 2 AND len(f) > 0)""")
def loanword_checks(spark, sf):
    """Every document against a banned pattern and a policy on loanwords: forbidden, allowed by a list, or free."""
    k = F.col("doc_id") % 3
    policy = F.when(k == 0, "forbid").when(k == 1, "allowlist").otherwise("free")
    rule = validators.register_rule(F.coalesce("text", F.lit("")), F.lit("ms"), F.lit(True), F.lit(False), banned=[], patterns=(r"\bth[aeiou]\b", "(no pattern"), policy=policy, allowed=validators.TELCO_LOANWORDS)
    return table(spark, sf, "documents").select("doc_id", F.inline(rule)).select("doc_id", "verdict", "reason")


# --- flow graphs -----------------------------------------------------------------------------------------------------

_FLOW = """SELECT CAST(o_orderkey AS BIGINT) AS g, o_custkey % 4 AS c, o_orderkey % 11 AS e, o_orderkey % 7 AS s, o_custkey % 5 AS t FROM {orders}"""


def _flows(spark, sf):
    """A graph for each order: two starts, a repeated node, one of no kind, an action with tools, edges of which some lead nowhere."""
    o = spark.sql(_FLOW.replace("{orders}", f"parquet.`{sf}/orders.parquet`"))
    document = F.format_string(
        '{"nodes": [{"id": "a", "type": "%s"}, 7, {"id": "n%d", "type": "intent"}, {"id": "n1", "type": "action", "data": {"toolIds": ["t%d", "t9", 3]}}, {"id": "z", "type": "start"}, {"type": "end"}],'
        ' "edges": [{"source": "a", "target": "n1"}, {"id": "e1", "source": "a", "target": "n%d", "label": "x"}, {"id": "k", "source": "z", "target": "q"}]}',
        F.when(F.col("s") == 0, "begin").otherwise("start"), F.col("c").cast("int"), F.col("t").cast("int"), F.col("c").cast("int"),
    )
    documents = o.select(F.col("g").alias("graph_id"), F.when(F.col("e") == 0, "[]").when(F.col("e") == 1, '{"nodes": 1}').otherwise(document).alias("document"))
    return documents, spark.createDataFrame([("t1",), ("t2",), ("t9",)], "tool_id string")


_SOUND = f"f AS (SELECT * FROM ({_FLOW}) WHERE e > 1)"


@query(f"""
WITH {_SOUND}
SELECT g AS graph_id, 0 AS place, 'a' AS id, 'start' AS kind, '' AS tools FROM f WHERE s > 0
UNION ALL SELECT g, 2, 'n' || c, 'intent', '' FROM f
UNION ALL SELECT g, 3, 'n1', 'action', CASE WHEN t IN (1, 2) THEN 't' || t || ',t9' ELSE 't9' END FROM f WHERE c <> 1
UNION ALL SELECT g, 4, 'z', CASE WHEN s > 0 THEN 'intent' ELSE 'start' END, '' FROM f""")
def flow_nodes(spark, sf):
    return graphs.coerced_nodes(*_flows(spark, sf)).withColumn("tools", F.array_join("tools", ","))


@query(f"""
WITH {_SOUND}
SELECT g AS graph_id, 0 AS place, 'e1' AS id, 'a' AS source, 'n1' AS target, NULL AS label FROM f WHERE s > 0
UNION ALL SELECT g, 1, 'e1_2', 'a', 'n' || c, 'x' FROM f WHERE s > 0""")
def flow_edges(spark, sf):
    return graphs.coerced_edges(_flows(spark, sf)[0])


@query(f"""
WITH {_SOUND}, all_flows AS ({_FLOW})
SELECT g AS graph_id, 'not_an_object' AS warning, NULL AS subject, CAST(1 AS BIGINT) AS n FROM all_flows WHERE e = 0
UNION ALL SELECT g, 'no_start', NULL, 1 FROM all_flows WHERE e = 1
UNION ALL SELECT g, 'invalid_node', NULL, 1 FROM f UNION ALL SELECT g, 'invalid_node', 'a', 1 FROM f WHERE s = 0
UNION ALL SELECT g, 'duplicate_node', 'n1', 1 FROM f WHERE c = 1
UNION ALL SELECT g, 'unknown_tools', 'n1', CASE WHEN t IN (1, 2) THEN 1 ELSE 2 END FROM f WHERE c <> 1
UNION ALL SELECT g, 'several_starts', NULL, 2 FROM f WHERE s > 0
UNION ALL SELECT g, 'dangling_edge', 'z→q', 1 FROM f
UNION ALL SELECT g, 'dangling_edge', 'a→n1', 1 FROM f WHERE s = 0 UNION ALL SELECT g, 'dangling_edge', 'a→n' || c, 1 FROM f WHERE s = 0""")
def flow_warnings(spark, sf):
    return graphs.coerced_warnings(*_flows(spark, sf))
