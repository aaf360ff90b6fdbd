"""Registered queries over runs, jobs and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import blocks, graphs, linting, runs
from weftline.plans.inputs import inputs
from weftline.plans.registry import query
from weftline.session import table

_BLOCKS = """t AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS BIGINT) AS block
  FROM {messages} m WHERE role <> 'system')"""


@query("SELECT o_orderkey FROM {orders} WHERE o_orderpriority <> '1-URGENT'")
def other_orders(spark, sf):
    return runs.without(table(spark, sf, "orders"), "o_orderpriority", "1-URGENT").select("o_orderkey")


@query("SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
def customers_with_orders(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return runs.with_any(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey")


@query("""
WITH n AS (SELECT DISTINCT CASE WHEN p_size = 1 THEN p_brand ELSE concat(p_brand, '-', p_size) END AS name FROM {part} WHERE starts_with(p_brand, 'Brand#1')),
u AS (SELECT CASE WHEN name = 'Brand#11' THEN 1 ELSE TRY_CAST(regexp_extract(name, '^Brand#11-(\\d+)$', 1) AS BIGINT) END AS n FROM n)
SELECT CASE WHEN min(k) = 1 THEN 'Brand#11' ELSE concat('Brand#11-', min(k)) END AS name FROM range(1, 100000) r(k) WHERE k NOT IN (SELECT n FROM u WHERE n IS NOT NULL)""")
def free_brand_name(spark, sf):
    name = F.when(F.col("p_size") == 1, F.col("p_brand")).otherwise(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    return runs.free_name(table(spark, sf, "part").select(name.alias("name")), "Brand#11")


_SORTED = "SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS score FROM {orders}"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")).alias("score"))


def _page(spark, sf, key, direction):
    return runs.sorted_page(_orders(spark, sf), {"price": F.col("o_totalprice"), "score": F.col("score")}, key, direction, "o_orderkey", limit=900, offset=100)


@query(f"SELECT * FROM ({_SORTED}) ORDER BY score ASC NULLS LAST, o_orderkey LIMIT 500 OFFSET 100")
def page_by_score(spark, sf):
    return _page(spark, sf, "score", "asc")[0]


@query(f"SELECT * FROM ({_SORTED}) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 500 OFFSET 100")
def page_by_unknown_key(spark, sf):
    return _page(spark, sf, "password; --", "sideways")[0]


@query("SELECT count(*) AS total, CAST(101 AS BIGINT) AS first, least(count(*), 600) AS last FROM {orders}")
def page_range(spark, sf):
    return _page(spark, sf, "score", "asc")[1]


@query("SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 200")
def oldest_orders(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "o_orderdate")


@query("SELECT item, judge, verdict FROM {judged} j ORDER BY verdict, item, judge LIMIT 300")
def verdicts_in_order(spark, sf):
    return inputs(spark, sf, "judged").orderBy("verdict", "item", "judge").limit(300).select("item", "judge", "verdict")


@query("""
(SELECT job_id, status, 'active' AS branch FROM {jobs} j WHERE status IN ('queued', 'running') ORDER BY job_id LIMIT 32)
UNION ALL (SELECT job_id, status, 'recent' FROM {jobs} j WHERE status NOT IN ('queued', 'running') ORDER BY job_id DESC LIMIT 32)""")
def active_and_recent_jobs(spark, sf):
    return runs.active_and_recent(inputs(spark, sf, "jobs"), ("queued", "running"), "job_id").select("job_id", "status", "branch")


@query("""
WITH t AS (SELECT CAST(s_suppkey AS VARCHAR) AS tool_id, s_name AS name FROM {supplier}),
w AS (SELECT tool_id AS asked FROM t UNION ALL SELECT name FROM t WHERE CAST(tool_id AS BIGINT) % 2 = 0 UNION ALL SELECT 'nobody')
SELECT asked, coalesce(i.tool_id, n.tool_id) AS tool_id, coalesce(i.name, n.name) AS name FROM w LEFT JOIN t i ON i.tool_id = asked LEFT JOIN t n ON n.name = asked
WHERE i.tool_id IS NOT NULL OR n.tool_id IS NOT NULL""")
def tools_by_id_or_name(spark, sf):
    tools = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("tool_id"), F.col("s_name").alias("name"))
    asked = tools.select(F.col("tool_id").alias("asked")).union(tools.where("CAST(tool_id AS BIGINT) % 2 = 0").select("name")).union(spark.range(1).select(F.lit("nobody")))
    return runs.by_id_or_name(asked, tools)


@query("SELECT coalesce(status, '(none)') AS label, count(*) AS n FROM {facts} f GROUP BY 1")
def labels_with_none(spark, sf):
    return runs.label_counts(inputs(spark, sf, "facts"), "status")


@query("""
WITH c AS (SELECT row AS conversation_id, name, count(*) AS n FROM {predicted} p GROUP BY 1, 2)
SELECT conversation_id, string_agg(name || '=' || n, ',' ORDER BY name) AS tally FROM c GROUP BY 1""")
def called_functions(spark, sf):
    found = runs.call_tally(inputs(spark, sf, "predicted").withColumnRenamed("row", "conversation_id"))
    return found.select("conversation_id", F.array_join(F.transform("tally", lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), ",").alias("tally"))


@query("""
WITH l AS (SELECT l_orderkey AS conversation_id, l_linenumber AS ordinal, CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block,
    CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE concat('ref-', l_suppkey % 5) END AS id FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY 1, 2) k WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT a.conversation_id, a.ordinal, coalesce(string_agg(DISTINCT b.id, ',' ORDER BY b.id), '') AS pool
FROM l a LEFT JOIN l b ON b.conversation_id = a.conversation_id AND b.block = a.block AND b.ordinal < a.ordinal WHERE a.block >= 1 GROUP BY 1, 2""")
def ids_known_so_far(spark, sf):
    user = F.col("l_linenumber") % 3 == 1
    # The table repeats line numbers of an order; a conversation's ordinals are its own.
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    rows = lines.select(
        F.col("l_orderkey").alias("conversation_id"), F.col("l_linenumber").alias("ordinal"), F.when(user, "user").otherwise("tool").alias("role"),
        F.format_string('{"ref": {"id": "ref-%d"}, "n": 1}', (F.col("l_suppkey") % 5).cast("int")).alias("content"),
    )
    pooled = runs.id_pool(blocks.with_blocks(rows), linting.harvested_ids(F.col("content")))
    return pooled.select("conversation_id", "ordinal", F.array_join("pool", ",").alias("pool"))


@query("WITH " + _BLOCKS + """,
b AS (SELECT conversation_id, block, string_agg('[' || upper(role) || '] ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY ordinal) AS x FROM t WHERE block >= 1 GROUP BY ALL)
SELECT a.conversation_id, a.block, sha256(string_agg(b.x, chr(10) || chr(10) ORDER BY b.block)) AS prefix FROM b a JOIN b ON b.conversation_id = a.conversation_id AND b.block <= a.block GROUP BY 1, 2""")
def transcript_prefix_texts(spark, sf):
    return runs.prefix_texts(blocks.with_blocks(inputs(spark, sf, "messages"))).withColumn("prefix", F.sha2("prefix", 256))


@query("""
WITH l AS (SELECT *, max(CASE WHEN role = 'assistant' THEN ordinal END) OVER (PARTITION BY conversation_id) AS last FROM {messages} m)
SELECT conversation_id, sha256(string_agg(role || ': ' || coalesce(content, ''), chr(10) ORDER BY ordinal)) AS shown FROM l WHERE ordinal <= last GROUP BY 1""")
def labelling_texts(spark, sf):
    rows = blocks.trim_to_reply(inputs(spark, sf, "messages"))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", F.concat("role", F.lit(": "), F.coalesce("content", F.lit(""))).alias("x"))))
    return rows.groupBy("conversation_id").agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["x"]), "\n"), 256).alias("shown"))


@query("SELECT conversation_id, CAST(greatest(1, sum(length(coalesce(content, ''))) // 4) AS BIGINT) AS tokens FROM {messages} m GROUP BY 1")
def prompt_sizes(spark, sf):
    return inputs(spark, sf, "messages").groupBy("conversation_id").agg(text.prompt_tokens(F.collect_list("content")).alias("tokens"))


_JOBS = "SELECT *, CASE WHEN status = 'succeeded' THEN job_id * 10 END AS conversation_id, run_id % 4 AS attempts FROM {jobs} j"


def _jobs(spark, sf):
    made = F.when(F.col("status") == "succeeded", F.col("job_id") * 10)
    return inputs(spark, sf, "jobs").withColumns({"conversation_id": made, "attempts": F.col("run_id") % 4})


@query(f"""
SELECT job_id, CASE WHEN tokens % 7 = 0 THEN 'queued' ELSE status END AS status, CASE WHEN tokens % 7 <> 0 THEN conversation_id END AS conversation_id, attempts FROM ({_JOBS})""")
def restarted_jobs(spark, sf):
    jobs = _jobs(spark, sf)
    return runs.restart(jobs, jobs.where("tokens % 7 = 0")).select("job_id", "status", "conversation_id", "attempts")


@query("SELECT job_id, 'queued' AS status, 0 AS attempts FROM {jobs} j")
def regenerated_jobs(spark, sf):
    return runs.restart(_jobs(spark, sf), zero_attempts=True).select("job_id", "status", F.col("attempts").cast("int").alias("attempts"))


@query("""
SELECT coalesce(c.c_custkey, k) AS c_custkey, coalesce(f, c_mktsegment) AS c_mktsegment, CASE WHEN c.c_custkey IS NULL THEN NULL ELSE c_name END AS c_name FROM {customer} c
FULL JOIN (SELECT CAST(o_custkey * 2 AS BIGINT) AS k, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'FLAGGED' END AS f FROM {orders} GROUP BY o_custkey) o ON k = c.c_custkey""")
def upserted_flags(spark, sf):
    flag = F.when(F.min("o_orderkey") % 2 == 0, "FLAGGED").alias("c_mktsegment")
    changes = table(spark, sf, "orders").groupBy((F.col("o_custkey") * 2).cast("long").alias("c_custkey")).agg(flag)
    return runs.upsert(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name"), changes, "c_custkey")


@query("SELECT n_name AS name FROM {nation} WHERE n_name NOT IN (SELECT r_name FROM {region}) AND n_name <> 'CANADA'")
def presets_to_add(spark, sf):
    existing = table(spark, sf, "region").select(F.col("r_name").alias("name")).union(spark.range(1).select(F.lit("CANADA")))
    return runs.missing_presets(table(spark, sf, "nation").select(F.col("n_name").alias("name")), existing)


@query("""
SELECT o_orderkey, o_orderstatus, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS turns
FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def orders_with_lines(spark, sf):
    items = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit("chat-replay").alias("kind"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("verdict"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit(None).cast("string").alias("o_orderstatus"), F.lit("chat-replay-turn").alias("kind"),
        F.col("l_linenumber").cast("int").alias("ordinal"), F.col("l_returnflag").alias("verdict"),
    )
    found = runs.turns_under_items(items.unionByName(lines), "o_orderkey")
    return found.select("o_orderkey", "o_orderstatus", F.array_join(F.transform("turns", lambda x: F.concat_ws(":", x["ordinal"].cast("string"), x["verdict"])), ",").alias("turns"))


@query("""
WITH p AS (SELECT source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, lang, coalesce(text, '') AS t FROM {documents})
SELECT grp AS "group", sha256(string_agg('### [' || i || '] ' || lang || chr(10) || t, chr(10) || chr(10) ORDER BY i)) AS block FROM p GROUP BY 1""")
def knowledge_blocks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("group"), "doc_id", F.col("lang").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return runs.knowledge_block(docs, "group", "doc_id").withColumn("block", F.sha2("block", 256))


@query("""
WITH p AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, CAST(ceil(sqrt(count(*) OVER (PARTITION BY s_nationkey))) AS BIGINT) AS c FROM {supplier})
SELECT s_suppkey, i % c * 240 AS x, i // c * 120 AS y FROM p""")
def box_layout(spark, sf):
    return runs.grid_places(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", 240, 120).select("s_suppkey", "x", "y")


@query("""
SELECT c_custkey, coalesce(p.primary, 'ms') AS primary, 'latin' AS script, coalesce(p.register, 'mixed') AS register, coalesce(p.allow_particles, true) AS allow_particles, 'allow' AS loanwords
FROM {customer} LEFT JOIN (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'en' END AS primary, CASE WHEN n_regionkey = 2 THEN 'formal' END AS register, n_nationkey % 2 = 0 AS allow_particles
  FROM {nation} WHERE n_nationkey < 20) p ON k = c_nationkey""".replace("AS primary", 'AS "primary"').replace("p.primary", 'p."primary"'))
def validator_contexts(spark, sf):
    n = F.col
    profiles = table(spark, sf, "nation").where("n_nationkey < 20").select(
        n("n_nationkey").alias("c_nationkey"), F.when(n("n_regionkey") == 1, "en").alias("primary"), F.when(n("n_regionkey") == 2, "formal").alias("register"), (n("n_nationkey") % 2 == 0).alias("allow_particles")
    )
    return runs.validator_context(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), profiles, "c_nationkey").drop("c_nationkey")


@query("""
SELECT item % 97 AS run, item, 'chat-replay' AS kind, CAST(NULL AS BIGINT) AS turn, max(verdict) AS verdict FROM {judged} j GROUP BY ALL
UNION ALL SELECT run, item, 'chat-replay-turn', CAST(judge AS BIGINT), verdict FROM {judged} j""")
def benchmark_results(spark, sf):
    judged = inputs(spark, sf, "judged")
    items = judged.groupBy("run", "item").agg(F.max("verdict").alias("verdict"))
    return runs.result_rows(items, judged.withColumnRenamed("judge", "turn"))


@query("""
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT * FROM {region} WHERE r_regionkey <> 2) r ON r.r_regionkey = n.n_regionkey WHERE o.o_orderstatus IN ('O', 'P')""")
def runs_with_parents(spark, sf):
    orders = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    # Both are tables of a fixed number of rows.
    nations = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")))
    regions = F.broadcast(table(spark, sf, "region").where("r_regionkey <> 2").select("r_regionkey", "r_name"))
    return orders.join(customers, "c_custkey").join(nations, "n_nationkey", "left").join(regions, "r_regionkey", "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT source, string_agg(target, ',' ORDER BY place, target) AS targets FROM {all_edges} e GROUP BY 1")
def adjacency_lists(spark, sf):
    found = graphs.adjacency(inputs(spark, sf, "all_edges"))
    return found.select("source", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query("SELECT list(DISTINCT k ORDER BY k) AS keys FROM (SELECT concat(l_returnflag, l_linestatus) AS k FROM {lineitem} UNION SELECT o_orderpriority FROM {orders})")
def union_of_keys(spark, sf):
    left = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"))
    return left.union(table(spark, sf, "orders").select("o_orderpriority")).distinct().agg(F.array_sort(F.collect_set("k")).alias("keys"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 10 AS BIGINT) AS score FROM {lineitem} WHERE l_suppkey % 10 BETWEEN 1 AND 5
UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM {lineitem} WHERE NOT (l_suppkey % 10 BETWEEN 1 AND 5)""")
def last_integers(spark, sf):
    answer = F.format_string("of 10: %d points.", (F.col("l_suppkey") % 10).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.last_integer(answer, 1, 5).alias("score"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS coverage, CASE l_linenumber % 3 WHEN 2 THEN 1.0 WHEN 1 THEN 1.0 ELSE 0.5 END AS types FROM {lineitem}""")
def argument_checks(spark, sf):
    schema = F.lit('{"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}, "b": {"type": "integer"}}}')
    k = F.col("l_linenumber") % 3
    given = F.when(k == 0, '{"a": 5, "b": 2}').when(k == 1, '{"a": "x"}').otherwise("{}")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", given.alias("given"))
    return rows.select("l_orderkey", "l_linenumber", linting.required_coverage(F.col("given"), schema).alias("coverage"), linting.type_accuracy(F.col("given"), schema).alias("types"))
