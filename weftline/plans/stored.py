"""Registered queries that write and read again: sources, sinks, commits, streams, exports; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import exports, lifecycle
from weftline.plans.inputs import inputs
from weftline.plans.registry import query
from weftline.plans.tools import _CALLED, _transcripts
from weftline.session import scratch, table
from weftline.sources import appends, readers, sinks
from weftline.streaming import follow

# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("""
SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, count(*) AS messages, sha256(string_agg(role || ':' || coalesce(content, ''), chr(10) ORDER BY ordinal)) AS digest
FROM {messages} m WHERE conversation_id IN (SELECT conversation_id FROM (SELECT DISTINCT conversation_id FROM {messages}) ORDER BY conversation_id % 3, conversation_id) AND
  conversation_id // 3 < 20 GROUP BY 1""")
def stored_string_rows(spark, sf):
    """Conversations as rows of strings, written and read with at most twenty of each split, which is the reader's feature."""
    path = scratch(spark, "strings")
    one = F.struct("ordinal", F.struct("role", "content").alias("m"))
    rows = inputs(spark, sf, "messages").groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"]).alias("messages"))
    sinks.write_string_rows(rows.select("*", (F.col("conversation_id") % 3).alias("split"), F.col("conversation_id").alias("row_idx"), F.array(F.struct(F.lit("f").alias("name"))).alias("functions")), path)
    numbered = spark.read.parquet(path).withColumn("row_idx", F.col("row_idx").cast("long")).write
    numbered.parquet(f"{path}-numbered")
    found = readers.string_rows(spark, f"{path}-numbered", max_rows=20)
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit(""))))
    return found.select("conversation_id", F.size("messages").cast("long").alias("messages"), F.sha2(F.array_join(shown, "\n"), 256).alias("digest"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS conversation_id, CASE WHEN o_orderkey % 2 = 0 THEN 'later' ELSE o_orderstatus END AS status FROM {orders}""")
def stored_checkpoints(spark, sf):
    """Results appended in two batches, of which the first is written twice; of each conversation the last line counts."""
    folder = scratch(spark, "checkpoints")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("conversation_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    for _ in range(2):
        appends.append_batch(orders.drop("even"), folder, "evaluate", 0, "json")
    appends.append_batch(orders.where("even").select("conversation_id", F.lit("later").alias("status")), folder, "evaluate", 1, "json")
    last = readers.checkpoint_lines(spark, f"{folder}/query=evaluate/*/*.json")
    return last.select("conversation_id", F.get_json_object("line", "$.status").alias("status"))


@query("SELECT s_name || CASE WHEN s_suppkey % 2 = 0 THEN '/m' ELSE '' END AS model FROM {supplier} WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0")
def stored_model_list(spark, sf):
    path, k = scratch(spark, "models"), F.col("s_suppkey")
    name = F.concat(F.lit("  "), "s_name", F.when(k % 2 == 0, "/m").otherwise(""), F.lit(" "))
    table(spark, sf, "supplier").select(F.when(k % 5 == 0, F.concat(F.lit("# "), name)).when(k % 7 == 0, "  ").otherwise(name).alias("value")).write.text(path)
    return readers.model_list(spark, path)


@query("""
SELECT CAST(o_custkey % 50 AS BIGINT) AS run_id, count(*) AS produced, count(*) FILTER (WHERE bad IS NULL) AS accepted, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS tokens
FROM {orders} LEFT JOIN (SELECT DISTINCT l_orderkey AS bad FROM {lineitem} WHERE l_returnflag = 'R') l ON bad = o_orderkey GROUP BY 1""")
def committed_run_counters(spark, sf):
    """Orders as conversations with their lines as validations, committed in two parts, the first of them twice under one name."""
    commits = appends.Commits(spark, scratch(spark, "commits"))
    key = F.col("o_orderkey").cast("long")
    orders = table(spark, sf, "orders").select(key.alias("conversation_id"), (F.col("o_custkey") % 50).cast("long").alias("run_id"), F.floor("o_totalprice").cast("long").alias("tokens"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("conversation_id"), F.lit("schema").alias("validator"), F.lit("correctness").alias("axis"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("verdict"), F.lit(None).cast("double").alias("score"))
    messages = orders.select("conversation_id", F.lit(0).cast("long").alias("ordinal"), F.lit("user").alias("role"), F.lit("x").alias("content"))
    for rest, name in ((0, "even"), (0, "even"), (1, "odd")):
        part = F.col("conversation_id") % 2 == rest
        appends.persist(commits, orders.where(part), messages.where(part), lines.where(part), name)
    return appends.run_counters(commits)


# --- streams ---------------------------------------------------------------------------------------------------------


def _streamed(spark, stream, name):
    """The rows that a stream leaves in a sink when it has read all that is there."""
    folder = scratch(spark, name)
    writer = stream.writeStream.foreachBatch(appends.append_once(folder, name)).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True)
    running = follow.started(writer, spark)
    running.awaitTermination()
    return appends.appended(spark, folder, stream.schema.simpleString()[7:-1])


@query("""
WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM {events})
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_type AS snapshot FROM l WHERE b IS NULL OR event_type <> b""")
def changed_snapshot_stream(spark, sf):
    """The snapshots that differ from the last of their user, by a stream over all events."""
    events, path = table(spark, sf, "events").select("user_id", "event_id", "event_type"), scratch(spark, "events")
    events.write.parquet(path)
    rows = spark.readStream.schema(events.schema).parquet(path)
    stream = follow.changed(rows.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("snapshot")), keep=None)
    return _streamed(spark, stream, "changed").select("key", "seq", "snapshot")


@query("""
WITH n AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS event FROM {events})
SELECT key, seq, event FROM n""")
def replayed_then_followed(spark, sf):
    """The first three events of each user as a batch, then a stream of all events, three times over: none is missing, none comes twice."""
    from pyspark.sql import Window as W

    events = table(spark, sf, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    rows = events.select(F.col("user_id").cast("string").alias("key"), seq.cast("long").alias("seq"), F.col("event_type").alias("event"), F.lit("{}").alias("payload"))
    path = scratch(spark, "followed")
    for _ in range(3):
        rows.write.mode("append").parquet(path)
    past = spark.read.schema(follow.EVENTS).parquet(path).where("seq < 3").select("key", "seq", "event").distinct()
    stream = follow.follow(spark.readStream.schema(follow.EVENTS).option("maxFilesPerTrigger", 4).parquet(path), past)
    return past.unionAll(_streamed(spark, stream, "follow").select("key", "seq", "event"))


# --- exports ---------------------------------------------------------------------------------------------------------


@query(f"""
WITH c AS ({_CALLED}), n AS (SELECT DISTINCT k, name FROM c),
f AS (SELECT k, string_agg(CASE WHEN name IN ('NO', 'RF') THEN '{{{{"name":"' || name || '"}}}}' ELSE '{{{{"name":"' || name || '","description":"(tool definition missing from catalog)","parameters":{{{{"type":"object","properties":{{{{}}}}}}}}}}}}' END, ',' ORDER BY name) AS listed FROM n GROUP BY 1)
SELECT CAST(k AS BIGINT) AS conversation_id, 2 + (SELECT count(*) FROM c WHERE c.k = f.k) AS messages, '{{{{"functions":[' || listed || ']}}}}' AS functions, CASE WHEN k % 2 = 0 THEN 'ms' END AS language FROM f""".replace("{{", "{").replace("}}", "}"))
def function_bench_export(spark, sf):
    messages = _transcripts(spark, sf)
    k = F.col("conversation_id")
    conversations = messages.select("conversation_id").distinct().select(k, F.when(k % 2 == 0, "ms").alias("language"))
    catalog = spark.createDataFrame([("NO", '{"name":"NO"}'), ("RF", '{"name":"RF"}'), ("AF", "{bad")], "name string, definition string")
    rows = exports.function_bench_rows(conversations, messages, catalog)
    counted = F.json_array_length(F.get_json_object("conversation", "$.messages")).cast("long")
    return rows.select("conversation_id", counted.alias("messages"), "functions", "language")


@query("""
WITH m AS (SELECT conversation_id, string_agg('{"ordinal":' || ordinal || ',"role":' || to_json(role) || ',"content":' || coalesce(to_json(content), 'null') || '}', ',' ORDER BY ordinal) AS listed FROM {messages} m GROUP BY 1)
SELECT doc_id AS conversation_id, sha256('{"conversation_id":' || doc_id || ',"language":' || coalesce(to_json(d.lang), 'null') || ',"created_at":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || ',"persona":' || CASE WHEN c_custkey IS NULL THEN 'null' ELSE '{"persona_id":' || c_custkey || ',"name":"' || c_name || '"}' END
  || ',"topic":' || CASE WHEN n_nationkey IS NULL THEN 'null' ELSE '{"topic_id":' || n_nationkey || ',"name":"' || n_name || '"}' END || ',"messages":[' || coalesce(listed, '') || ']}') AS digest
FROM {documents} d LEFT JOIN {customer} c ON c_custkey = doc_id % 2000 LEFT JOIN {nation} n ON n_nationkey = doc_id % 30 LEFT JOIN m ON m.conversation_id = d.doc_id""")
def nested_export(spark, sf):
    docs, key = table(spark, sf, "documents"), F.col("doc_id")
    conversations = docs.select(key.alias("conversation_id"), F.col("lang").alias("language"), (key % 2000).alias("persona_id"), (key % 30).alias("topic_id"), F.col("n_chars").alias("created_at"))
    personas = table(spark, sf, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_name").alias("name"))
    topics = table(spark, sf, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("name"))
    found = exports.nested_records(conversations, inputs(spark, sf, "messages"), personas, topics)
    return found.select("conversation_id", F.sha2("record", 256).alias("digest"))


@query("""
WITH v AS (SELECT l_orderkey AS k, string_agg('{"validator":"' || l_returnflag || '","verdict":"' || l_linestatus || '","place":' || l_linenumber || '}', ',' ORDER BY l_returnflag, l_linestatus, l_linenumber) AS listed FROM {lineitem} GROUP BY 1),
e AS (SELECT user_id AS j, string_agg('{"seq":' || event_id || ',"kind":"' || event_type || '"}', ',' ORDER BY event_id) AS listed FROM {events} GROUP BY 1)
SELECT CAST(o_orderkey AS BIGINT) AS conversation_id, '{"_schemaVersion":1,"conversation":{"conversation_id":' || o_orderkey || ',"run_id":' || o_custkey || ',"status":"' || o_orderstatus || '"},"messages":[],"validations":[' || coalesce(v.listed, '') || '],"persona":'
  || CASE WHEN n_nationkey IS NULL THEN 'null' ELSE '{"persona_id":' || n_nationkey || ',"name":"' || n_name || '"}' END || ',"run":' || CASE WHEN c_custkey IS NULL THEN 'null' ELSE '{"run_id":' || c_custkey || ',"name":"' || c_name || '"}' END
  || ',"job":' || CASE WHEN o_orderkey % 3 = 0 THEN '{"job_id":' || (o_orderkey // 10 + 1) || '}' ELSE 'null' END || ',"events":[' || CASE WHEN o_orderkey % 3 = 0 THEN coalesce(e.listed, '') ELSE '' END || ']}' AS trace
FROM {orders} o LEFT JOIN v ON v.k = o_orderkey LEFT JOIN {nation} n ON n_nationkey = o_custkey % 30 LEFT JOIN {customer} c ON c_custkey = o_custkey AND o_custkey % 4 > 0 LEFT JOIN e ON e.j = o_orderkey // 10 + 1""")
def conversation_traces(spark, sf):
    """Orders as conversations: lines as validations, of two jobs the last, and that job's events."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    conversations = o.select(key.cast("long").alias("conversation_id"), (F.col("o_custkey") % 30).alias("persona_id"), F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    personas = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("persona_id"), F.col("n_name").alias("name"))
    runs = table(spark, sf, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"))
    last = F.floor(key / 10) + 1
    jobs = o.where("o_orderkey % 3 = 0").select(key.cast("long").alias("conversation_id"), F.explode(F.array(last - 1, last)).alias("job_id"))
    events = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    checks = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("conversation_id"), F.col("l_returnflag").alias("validator"), F.col("l_linestatus").alias("verdict"), F.col("l_linenumber").alias("place"))
    none = spark.createDataFrame([], "conversation_id long, ordinal long, role string, content string")
    return exports.traces(conversations, none, checks, personas, runs, jobs, events)


# --- files, libraries, runs made anew --------------------------------------------------------------------------------


@query(r"""
SELECT CASE doc_id % 5 WHEN 0 THEN 'd.TXT' WHEN 1 THEN 'd.pdf' WHEN 2 THEN 'd' WHEN 3 THEN 'd.docx' ELSE 'd.bin' END || doc_id % 5 AS name, kind, CASE WHEN n > 6000 THEN 'too_large' WHEN kind = 'txt' THEN 'ok' ELSE 'unsupported' END AS status,
  CASE WHEN n <= 6000 AND kind = 'txt' THEN sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) END AS text
FROM (SELECT *, strlen(text) AS n, CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' WHEN 3 THEN 'docx' END AS kind FROM {documents} WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')""")
def texts_of_files(spark, sf):
    """Documents as files of five kinds, by their media types; large ones are not read."""
    k = F.col("doc_id") % 5
    mime = F.when(k == 0, "text/plain").when(k == 1, "application/pdf").when(k == 2, "text/csv").when(k == 3, "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("application/octet-stream")
    name = F.concat(F.when(k == 0, "d.TXT").when(k == 1, "d.pdf").when(k == 2, "d").when(k == 3, "d.docx").otherwise("d.bin"), k.cast("string"))
    docs = table(spark, sf, "documents").where(r"text RLIKE '[^ \\t\\n\\r]'")
    found = readers.file_texts(docs.select(name.alias("name"), mime.alias("mime"), F.encode("text", "UTF-8").alias("content")), most_bytes=6000)
    return found.withColumn("text", F.sha2("text", 256))


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS row_idx, CASE o_custkey % 3 WHEN 0 THEN 'c' || o_orderkey ELSE CASE o_custkey % 2 WHEN 0 THEN 'returns' ELSE 'workflow' END || '-' || o_orderkey END AS conversation_id,
  '{"domain":"' || o_orderstatus || '","workflow":"' || CASE o_custkey % 2 WHEN 0 THEN 'returns' ELSE '' END || '","shared_entities":' || CASE o_custkey % 5 WHEN 0 THEN '{"e":1}' ELSE '{}' END || ',"functions":' || CASE o_custkey % 5 WHEN 1 THEN '[{"name":"f"}]' ELSE '[]' END || '}' AS library
FROM {orders} WHERE o_orderkey % 4 > 1""")
def library_pairs_of_rows(spark, sf):
    """Rows with their own libraries, of which parts lack or are no JSON; messages that are empty or broken drop the row."""
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        key.cast("long").alias("row_idx"), F.when(c % 3 == 0, F.concat(F.lit("c"), key.cast("string"))).when(c % 3 == 1, "").alias("conversation_id"), F.when(c % 2 == 0, "returns").alias("workflow"), F.col("o_orderstatus").alias("domain"),
        F.when(c % 5 == 0, '{"e":1}').when(c % 5 == 1, "[]").when(c % 5 == 2, "{bad").alias("shared_entities"), F.when(c % 5 == 1, '[{"name":"f"}]').when(c % 5 == 3, "{}").alias("functions"),
        F.when(key % 4 == 0, "[]").when(key % 4 == 1, "{bad").otherwise('[{"role":"user"}]').alias("messages"),
    )
    return readers.library_pairs(rows).select("row_idx", "conversation_id", "library")


@query("""
WITH r AS (SELECT CAST(c_custkey AS BIGINT) AS run_id, c_nationkey AS n, CASE c_custkey % 3 WHEN 0 THEN ['p1', 'p2'] WHEN 1 THEN ['p3'] ELSE [NULL] END AS p, CASE c_custkey % 2 WHEN 0 THEN ['t1', 't2', 't3'] ELSE [NULL] END AS t, ['easy', 'hard'] AS d, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey % 4 ELSE 1 END AS m FROM {customer}),
a AS (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM r), b AS (SELECT *, unnest(range(1, len(t) + 1)) AS j FROM a), c AS (SELECT *, unnest(range(1, len(d) + 1)) AS k FROM b), e AS (SELECT *, unnest(range(1, m + 1)) AS x FROM c)
SELECT run_id, CAST((((i - 1) * len(t) + j - 1) * len(d) + k - 1) * m + x - 1 AS BIGINT) AS place, p[i] AS persona, t[j] AS topic, d[k] AS difficulty FROM e""")
def replicated_jobs(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    personas = F.when(k % 3 == 0, '["p1", "p2"]').when(k % 3 == 1, '["p3"]').otherwise("[]")
    topics = F.when(k % 2 == 0, ', "taxonomyNodeIds": ["t1", "t2", "t3"]').otherwise("")
    config = F.format_string('{"personaIds": %s%s, "difficulties": ["easy", "hard"], "samplesPerCell": %d}', personas, topics, (n % 4).cast("int"))
    return lifecycle.replicated(table(spark, sf, "customer").select(k.cast("long").alias("run_id"), config.alias("config")))
