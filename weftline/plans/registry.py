"""All registered queries of this package with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import judge, language, text
from weftline.operators import blocks, dashboard, datasets, graphs, lifecycle, scoring, selection, validators
from weftline.plans.inputs import inputs, sql_of
from weftline.session import table
from weftline.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "validate_replies"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql_of(sql)
        return f

    return add


# --- conversations -------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS block
  FROM {messages} m WHERE role <> 'system')
SELECT conversation_id, CAST(block AS BIGINT) AS block, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM t WHERE block >= 1 GROUP BY ALL""")
def turn_blocks(spark, sf):
    found = blocks.with_blocks(inputs(spark, sf, "messages")).groupBy("conversation_id", "block")
    return found.agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("""
SELECT conversation_id, sha256(arg_max(content, ordinal)) AS hash FROM {messages} m WHERE role = 'assistant' GROUP BY 1""")
def closing_reply_hashes(spark, sf):
    return blocks.closing_replies(inputs(spark, sf, "messages")).select("conversation_id", text.content_hash(F.col("reply")).alias("hash"))


@query("""
SELECT conversation_id, arg_min(content, ordinal) FILTER (WHERE role = 'system') AS system_text,
  arg_min(content, ordinal) FILTER (WHERE role = 'user') AS user_text FROM {messages} m GROUP BY 1""")
def conversation_openings(spark, sf):
    return blocks.openings(inputs(spark, sf, "messages"))


@query("""
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS block
  FROM {messages} m WHERE role <> 'system'),
r AS (SELECT conversation_id, ordinal, CAST(block AS BIGINT) AS block, row_number() OVER (PARTITION BY conversation_id, block ORDER BY ordinal) AS p
  FROM t WHERE block >= 1 AND role = 'assistant')
SELECT conversation_id, ordinal, block, CASE WHEN p = 1 THEN 'turn.assistant' ELSE 'turn.followup' END AS event FROM r""")
def reply_events(spark, sf):
    return blocks.numbered_replies(inputs(spark, sf, "messages")).select("conversation_id", "ordinal", "block", "event")


@query("""
SELECT conversation_id, string_agg('[' || upper(role) || '] ' || content, chr(10) || chr(10) ORDER BY ordinal) AS transcript
FROM {messages} m GROUP BY 1""")
def conversation_transcripts(spark, sf):
    return blocks.transcripts(inputs(spark, sf, "messages"))


@query("""
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS block
  FROM {messages} m WHERE role <> 'system'),
b AS (SELECT conversation_id, CAST(block AS BIGINT) AS block, count(*) AS n, sum(length(content)) AS c FROM t WHERE block >= 1 GROUP BY ALL)
SELECT conversation_id, block, CAST(sum(n) OVER w AS BIGINT) AS messages_so_far, CAST(sum(c) OVER w AS BIGINT) AS chars_so_far
FROM b WINDOW w AS (PARTITION BY conversation_id ORDER BY block)""")
def transcript_prefixes(spark, sf):
    return blocks.prefix_sizes(inputs(spark, sf, "messages"))


@query("""
WITH l AS (SELECT *, max(CASE WHEN role = 'assistant' THEN ordinal END) OVER (PARTITION BY conversation_id) AS last FROM {messages} m)
SELECT conversation_id, count(*) AS n FROM l WHERE ordinal <= last GROUP BY 1""")
def labelling_trim(spark, sf):
    return blocks.trim_to_reply(inputs(spark, sf, "messages")).groupBy("conversation_id").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT source AS grp, doc_id AS place, substr(coalesce(text, ''), 1, 4000) AS t FROM {documents}),
c AS (SELECT *, sum(length(t) + 7) OVER w - 7 AS total, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY grp ORDER BY place))
SELECT grp AS "group", count(*) FILTER (WHERE total <= 40000 OR i = 1) AS kept, count(*) FILTER (WHERE NOT (total <= 40000 OR i = 1)) AS omitted,
  sha256(coalesce(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) FILTER (WHERE total <= 40000 OR i = 1), '')) AS text
FROM c GROUP BY 1""")
def budgeted_context(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("place"), "text")
    return blocks.budgeted(docs).withColumn("text", F.sha2("text", 256))


# --- validators ----------------------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_GRAMS = (
    "g0 AS (SELECT conversation_id, " + _WORDS + " AS w FROM x),"
    " g1 AS (SELECT conversation_id, w, unnest(range(1, len(w) - 3)) AS i FROM g0 WHERE len(w) >= 30),"
    " g2 AS (SELECT conversation_id, array_to_string(w[i:i + 4], ' ') AS gram, count(*) AS times, min(i) AS first FROM g1 GROUP BY ALL),"
    " g3 AS (SELECT conversation_id, arg_max(gram, times * 1000000 - first) AS gram, max(times) AS times, sum(times) AS grams FROM g2 GROUP BY 1),"
    " g4 AS (SELECT g0.conversation_id, gram, coalesce(times, 0) AS times, coalesce(grams, 0) AS grams FROM g0 LEFT JOIN g3 USING (conversation_id)),"
    " rep AS (SELECT conversation_id, CASE WHEN grams = 0 THEN 'pass' WHEN times / grams > 0.5 THEN 'fail' WHEN times / grams > 0.3 THEN 'warn' ELSE 'pass' END AS verdict,"
    " CASE WHEN grams = 0 THEN 1.0 ELSE 1 - times / grams END AS score, CASE WHEN grams > 0 THEN round(times / grams, 3) END AS ratio,"
    " CASE WHEN grams > 0 AND times / grams > 0.3 THEN gram END AS gram, times, CAST(grams AS BIGINT) AS grams FROM g4)"
)
_REPLIES = "x AS (SELECT conversation_id, arg_max(content, ordinal) AS text FROM {messages} m WHERE role = 'assistant' GROUP BY 1)"


def _language_model(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    return language.train(language.sampled(docs, "doc_id"))


# Trigram buckets of {t}, a model of the sampled documents, and for rows x (id, text) the likeliest language.
_BUCKETS = r"""list_transform(range(1, len({c}) - 1), lambda i: (unicode({c}[i]) * 6151 + unicode({c}[i + 1]) * 97 + unicode({c}[i + 2])) % 8191)"""
_PLAIN = r"trim(regexp_replace(lower(coalesce({t}, '')), '[^\p{{L}}]+', ' ', 'g'))"
_CHARS = "CASE WHEN " + _PLAIN + " = '' THEN [] ELSE regexp_extract_all(' ' || " + _PLAIN + " || ' ', '(?s).') END"


def _detected(key: str) -> str:
    return f"""
ln AS (SELECT lang, count(*) AS n FROM {{documents}} WHERE lang IS NOT NULL GROUP BY 1),
ls AS (SELECT lang, {_CHARS.format(t="text")} AS c FROM {{documents}} JOIN ln USING (lang) WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) < least(4294967296, {language.SAMPLE_ROWS} * 4294967296 // n)),
lc AS (SELECT lang, b, count(*) AS c FROM (SELECT lang, unnest({_BUCKETS.format(c="c")}) AS b FROM ls) GROUP BY ALL),
lt AS (SELECT lang, sum(c) + 0.5 * 8191 AS n FROM lc GROUP BY 1),
lx AS (SELECT {key}, b, count(*) AS c FROM (SELECT {key}, unnest({_BUCKETS.format(c="c")}) AS b FROM (SELECT {key}, {_CHARS.format(t="text")} AS c FROM x)) GROUP BY ALL),
lg AS (SELECT {key}, lt.lang, sum(lx.c * ln((coalesce(lc.c, 0) + 0.5) / lt.n)) AS l FROM lx CROSS JOIN lt LEFT JOIN lc ON lc.lang = lt.lang AND lc.b = lx.b GROUP BY ALL),
lm AS (SELECT *, max(l) OVER (PARTITION BY {key}) AS top FROM lg),
lang AS (SELECT {key}, arg_max(lang, (l, -ascii(lang))) AS detected, 1 / sum(exp(l - top)) AS confidence FROM lm GROUP BY 1)"""


def _replies(spark, sf):
    found = blocks.closing_replies(inputs(spark, sf, "messages")).select("conversation_id", F.col("reply").alias("text"))
    return validators.with_language(found, _language_model(spark, sf))


@query(f"""
WITH x AS (SELECT doc_id, text FROM {{documents}}), {_detected("doc_id")}
SELECT doc_id, detected, round(confidence, 6) AS confidence, CASE WHEN detected IS NULL THEN 'warn' WHEN detected = 'fr' THEN 'pass' WHEN detected = 'en' THEN 'warn' ELSE 'fail' END AS verdict
FROM x LEFT JOIN lang USING (doc_id)""")
def document_languages(spark, sf):
    docs = validators.with_language(table(spark, sf, "documents").select("doc_id", "text"), _language_model(spark, sf))
    rule = validators.language_rule(F.col("detected"), F.lit("fr"), F.lit("rojak"), F.col("confidence"))
    return docs.select("doc_id", "detected", F.round("confidence", 6).alias("confidence"), F.element_at(rule, 1)["verdict"].alias("verdict"))


def _hits(words):
    listed = "|".join(sorted(words))
    return f"regexp_matches(coalesce(text, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}_])({listed})($|[^\\p{{L}}\\p{{N}}_])')"


_RESULTS = f"""
WITH {_REPLIES}, {_GRAMS}, {_detected("conversation_id")},
r AS (
  SELECT conversation_id, 'schema' AS validator, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'fail' WHEN length(text) > 50000 THEN 'warn' ELSE 'pass' END AS verdict,
    CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND length(text) <= 50000 THEN 1.0 END AS score FROM x
  UNION ALL SELECT conversation_id, 'langid', CASE WHEN detected IS NULL OR detected = 'en' THEN 'warn' ELSE 'fail' END, confidence FROM x LEFT JOIN lang USING (conversation_id)
  UNION ALL SELECT conversation_id, 'register-compliance', 'fail', NULL FROM x WHERE {_hits(validators.PARTICLES)}
  UNION ALL SELECT conversation_id, 'register-compliance', 'fail', NULL FROM x WHERE {_hits(validators.SHORTCUTS)}
  UNION ALL SELECT conversation_id, 'register-compliance', 'pass', 1.0 FROM x WHERE NOT {_hits(validators.PARTICLES)} AND NOT {_hits(validators.SHORTCUTS)}
  UNION ALL SELECT conversation_id, 'ngram-repetition', verdict, score FROM rep)
"""


@query(_RESULTS + """
SELECT conversation_id, CASE WHEN bool_or(verdict = 'fail') THEN 'rejected' ELSE 'accepted' END AS status,
  count(*) FILTER (WHERE verdict = 'fail') AS fails, count(*) FILTER (WHERE verdict = 'warn') AS warns FROM r GROUP BY 1""")
def validate_replies(spark, sf):
    return validators.accept(validators.run_validators(_replies(spark, sf), policy="rojak"))


@query(_RESULTS + """
SELECT validator, count(*) AS total, avg(CAST(verdict = 'pass' AS INT)) AS pass_rate, avg(CAST(verdict = 'warn' AS INT)) AS warn_rate,
  avg(CAST(verdict = 'fail' AS INT)) AS fail_rate, round(CAST(avg(score) AS DOUBLE), 9) AS mean_score FROM r GROUP BY 1""")
def validator_rates(spark, sf):
    return validators.validator_rollup(validators.run_validators(_replies(spark, sf), policy="rojak")).withColumn("mean_score", F.round("mean_score", 9))


@query("WITH x AS (SELECT doc_id AS conversation_id, text FROM {documents}), " + _GRAMS + " SELECT * FROM rep")
def document_repetition(spark, sf):
    return validators.repetition(table(spark, sf, "documents").select(F.col("doc_id").alias("conversation_id"), "text"))


@query(r"""
SELECT conversation_id, ordinal, CASE WHEN coalesce(content, '') = '' THEN true ELSE regexp_matches(
  lower(substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 120)),
  '^(you are |you must |you should |you will |act as |speak in |respond in |base your communication|you write |your role is|as a )') END AS prompt_like,
  CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END AS tokens FROM {messages} m""")
def message_checks(spark, sf):
    found = inputs(spark, sf, "messages")
    return found.select("conversation_id", "ordinal", text.looks_like_system_prompt(F.col("content")).alias("prompt_like"), text.token_estimate(F.col("content")).alias("tokens"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\*\*([^*]+?)\*\*', '\1', 'g'), '\b_([^_]+?)_\b', '\1', 'g') AS t FROM {documents}),
b AS (SELECT doc_id, replace(replace(t, '**', chr(1) || chr(1)), chr(1) || '*', chr(1) || chr(1)) AS t FROM a),
c AS (SELECT doc_id, replace(regexp_replace(t, '\*([^*\x01]+?)\*', '\1', 'g'), chr(1), '*') AS t FROM b)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '`([^`]+?)`', '\1', 'g'),
  '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b', '[…]', 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS scrubbed FROM c""")
def scrubbed_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.scrub(F.col("text")), 256).alias("scrubbed"))


@query()
def scrubbed_all_documents(spark, sf):
    """The same, held against plain Python in a test."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.scrub(F.col("text")), 256).alias("scrubbed"))


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS hash FROM {documents}), k AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS i FROM d)
SELECT doc_id, hash FROM k WHERE i = 1 OR hash IS NULL""")
def exact_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return validators.drop_repeats(docs, "hash", "doc_id")


# --- scores --------------------------------------------------------------------------------------------------------


def _consensus(method):
    def run(spark, sf):
        return scoring.consensus(inputs(spark, sf, "scores"), ["item"], method)

    run.__name__ = f"consensus_{method}"
    return run


for _method, _how in (("median", "quantile_disc(score, 0.5)"), ("mean", "avg(score)"), ("min", "min(score)")):
    query(f"SELECT item, axis, {_how} AS score FROM {{scores}} s GROUP BY 1, 2")(_consensus(_method))


@query("""
WITH a AS (SELECT item, axis, median(score) AS m, max(score) - min(score) AS spread FROM {scores} s GROUP BY 1, 2),
v AS (SELECT item, max(CASE verdict WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS r FROM {judged} j GROUP BY 1)
SELECT item, max(m) FILTER (WHERE axis = 'accuracy') AS accuracy, max(m) FILTER (WHERE axis = 'fluency') AS fluency, max(m) FILTER (WHERE axis = 'tone') AS tone,
  max(spread) AS max_spread, any_value(CASE r WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END) AS verdict FROM a JOIN v USING (item) GROUP BY 1""")
def judge_ensemble(spark, sf):
    found = scoring.ensemble(inputs(spark, sf, "scores"), inputs(spark, sf, "judged"), ["item"])
    return found.select("item", *[F.try_element_at("medians", F.lit(a)).alias(a) for a in ("accuracy", "fluency", "tone")], "max_spread", "verdict")


@query("SELECT item, axis, max(score) - min(score) AS spread FROM {scores} s GROUP BY 1, 2")
def judge_disagreement(spark, sf):
    return scoring.disagreement(inputs(spark, sf, "scores"), ["item"])


@query("""
WITH m AS (SELECT split, axis, avg(score) AS mean FROM {scores} s GROUP BY GROUPING SETS ((split, axis), (axis))),
f AS (SELECT split, axis, scale FROM (SELECT DISTINCT split FROM {scores} s UNION ALL SELECT NULL),
  (VALUES ('accuracy', 5), ('fluency', 5), ('tone', 5), ('empathy', 5)) v(axis, scale))
SELECT f.split, f.axis, mean / scale AS score FROM f LEFT JOIN m ON f.axis = m.axis AND f.split IS NOT DISTINCT FROM m.split""")
def axis_rollup(spark, sf):
    return scoring.axis_rollup(inputs(spark, sf, "scores"), {"accuracy": 5, "fluency": 5, "tone": 5, "empathy": 5}, "split")


@query("""
SELECT item, avg(accuracy) AS accuracy, avg(fluency) AS fluency,
  CASE max(CASE verdict WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict,
  string_agg(verdict, chr(10) ORDER BY judge, verdict) AS rationale, CAST(sum(tokens) AS BIGINT) AS tokens FROM {judged} j GROUP BY 1""")
def turns_to_conversations(spark, sf):
    turns = inputs(spark, sf, "judged").withColumns({"turn": F.col("judge"), "rationale": F.col("verdict")})
    return scoring.turns_to_items(turns, ["item"], ["accuracy", "fluency"])


_DRIFT = """
WITH e AS (SELECT item, axis, avg(score) AS expected FROM {scores} s WHERE judge = 1 GROUP BY 1, 2),
a AS (SELECT item, axis, avg(score) AS actual FROM {scores} s WHERE judge = 2 GROUP BY 1, 2),
d AS (SELECT item, axis, abs(actual - expected) AS delta FROM e JOIN a USING (item, axis))
"""


def _drift(spark, sf):
    scores = inputs(spark, sf, "scores")
    side = lambda j: scores.where(F.col("judge") == j).groupBy("item", "axis").agg(F.avg("score").alias("score"))
    return scoring.calibration_drift(side(1), side(2), ["item"])


@query(_DRIFT + "SELECT item, max(delta) AS max_delta, max(delta) > 1.0 AS flagged FROM d GROUP BY 1")
def calibration_items(spark, sf):
    return _drift(spark, sf)[0]


@query(_DRIFT + "SELECT max(delta) AS max_delta, avg(delta) AS mean_delta, count(*) AS n_deltas FROM d")
def calibration_overall(spark, sf):
    return _drift(spark, sf)[1]


@query("""
SELECT count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'warn') AS n_warn,
  count(*) FILTER (WHERE verdict = 'fail') AS n_fail FROM {judged} j""")
def verdict_counts(spark, sf):
    return scoring.verdict_counts(inputs(spark, sf, "judged"))


@query("""
WITH j AS (SELECT coalesce(e.row, p.row) AS row, coalesce(e.place, p.place) AS place,
  CASE WHEN p.row IS NULL THEN 'missing' WHEN e.row IS NULL THEN 'extra' ELSE 'match' END AS type, coalesce(e.name = p.name, false) AS same
  FROM {expected} e FULL JOIN {predicted} p ON e.row = p.row AND e.turn = p.turn AND e.place = p.place)
SELECT type, same AS func_match, count(*) AS n FROM j GROUP BY 1, 2""")
def tool_call_matches(spark, sf):
    found = scoring.match_calls(inputs(spark, sf, "expected"), inputs(spark, sf, "predicted"), ["row", "turn"])
    return found.groupBy("type", "func_match").agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT * FROM {calls} c WHERE NOT api_failed),
t AS (SELECT row, turn, bool_and(type = 'match' AND accuracy = 1.0) AS perfect FROM v GROUP BY 1, 2)
SELECT count(*) AS total_calls, (SELECT count(*) FROM t) AS total_turns, CAST(sum(total) AS BIGINT) AS total_params,
  avg(CAST(func_match AS INT)) AS function_accuracy, sum(correct) / sum(total) AS parameter_accuracy,
  (SELECT avg(CAST(perfect AS INT)) FROM t) AS turn_level_parameter_accuracy, CAST(sum(similarity) / count(*) AS DOUBLE) AS argument_similarity FROM v""")
def tool_call_metrics(spark, sf):
    calls = inputs(spark, sf, "calls").withColumns({"similarity": F.col("similarity").cast("double"), "accuracy": F.col("accuracy").cast("double")})
    return scoring.call_metrics(calls)


# A predicted call's arguments are JSON that lacks its last brace where their number is divisible by three; the name XX is in
# no library; every fifth row is out of context.
_EVAL = """
WITH e AS (SELECT row, turn, list(name) AS names, count(*) AS n FROM {expected} x GROUP BY 1, 2),
p AS (SELECT row, turn, list(name) AS names, count(*) AS n, count(*) FILTER (WHERE json_valid('{"n": ' || arguments || CASE WHEN CAST(arguments AS BIGINT) % 3 = 0 THEN '' ELSE '}' END)) AS jv, count(*) FILTER (WHERE name = 'XX') AS h FROM {predicted} y GROUP BY 1, 2),
t AS (SELECT coalesce(e.row, p.row) AS row, coalesce(e.names, []) AS ref_names, coalesce(p.names, []) AS model_names,
  coalesce(e.n, 0) AS ref_count, coalesce(p.n, 0) AS model_count, coalesce(jv, 0) AS jv, coalesce(h, 0) AS h FROM e FULL JOIN p USING (row, turn)),
b AS (SELECT *, len(list_intersect(ref_names, model_names)) AS common, ref_count > 0 AND model_count > 0 AS both_sides, row % 5 = 0 AS outside FROM t),
a AS (SELECT sum(least(ref_count, model_count)) AS tp, sum(greatest(model_count - ref_count, 0)) AS fp, sum(greatest(ref_count - model_count, 0)) AS fn,
  sum(CASE WHEN both_sides THEN common ELSE 0 END) AS stp,
  sum(CASE WHEN both_sides THEN len(list_distinct(model_names)) - common ELSE 0 END) AS sfp,
  sum(CASE WHEN both_sides THEN len(list_distinct(ref_names)) - common ELSE 0 END) AS sfn,
  sum(CASE WHEN both_sides THEN common / greatest(ref_count, model_count) END) / count(*) FILTER (WHERE both_sides) AS na,
  sum(jv) / sum(model_count) AS j, sum(h) / sum(model_count) AS h, count(*) FILTER (WHERE outside AND model_count = 0) / count(*) FILTER (WHERE outside) AS refusal,
  count(*) FILTER (WHERE ref_count > 0) AS parallel, count(*) FILTER (WHERE ref_count > 0 AND ref_count = model_count) AS same FROM b),
r AS (SELECT *, round(tp / (tp + fp), 4) AS p, round(tp / (tp + fn), 4) AS c, round(stp / (stp + sfp), 4) AS sp, round(stp / (stp + sfn), 4) AS sc, round(same / parallel, 4) AS m FROM a)
SELECT p AS tool_call_precision, c AS tool_call_recall, round(2 * p * c / (p + c), 4) AS tool_call_f1, sp AS name_set_precision, sc AS name_set_recall,
  round(2 * sp * sc / (sp + sc), 4) AS name_set_f1, m AS parallel_count_match, round(na, 4) AS name_accuracy, round(j, 4) AS json_valid_rate,
  round(h, 4) AS hallucination_rate, round(refusal, 4) AS refusal_rate FROM r"""


@query(_EVAL)
def evaluator_metrics(spark, sf):
    side = lambda n: inputs(spark, sf, n).select("row", "turn", "name", "arguments", F.lit(n == "predicted").alias("model"))
    model = F.col("model")
    said = F.concat(F.lit('{"n": '), "arguments", F.when(F.col("arguments").cast("long") % 3 == 0, "").otherwise("}"))
    turns = side("expected").unionByName(side("predicted")).groupBy("row", "turn").agg(
        F.collect_list(F.when(~model, F.col("name"))).alias("ref_names"), F.collect_list(F.when(model, F.col("name"))).alias("model_names"),
        F.count_if(~model).alias("ref_count"), F.count_if(model).alias("model_count"),
        F.count_if(model & F.try_parse_json(said).isNotNull()).alias("json_valid"), F.count_if(model & (F.col("name") == "XX")).alias("hallucinated"),
    )
    a, b = F.col("ref_count"), F.col("model_count")
    turns = turns.withColumns({
        "tp": F.least(a, b), "fp": F.greatest(b - a, F.lit(0)), "fn": F.greatest(a - b, F.lit(0)), "out_of_context": F.col("row") % 5 == 0,
        "name_matches": F.size(F.array_intersect("ref_names", "model_names")),
    })
    return scoring.evaluator_metrics(turns)


@query("""
WITH s AS (SELECT item, min(least(accuracy, fluency)) AS m FROM {judged} j GROUP BY 1) SELECT round(m / 5, 1) AS bucket, count(*) AS n FROM s GROUP BY 1""")
def weakest_axis_histogram(spark, sf):
    worst = inputs(spark, sf, "judged").groupBy("item").agg(F.min(F.least("accuracy", "fluency")).alias("m"))
    return dashboard.histogram(worst, F.col("m") / 5)


# --- selection and datasets ----------------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seq) AS i FROM {candidates} c),
d AS (SELECT * FROM k WHERE i = 1 OR hash IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, seq) AS rank_in_cell, min(seq) OVER (PARTITION BY cell) AS f FROM d)
SELECT seq, cell, score, CAST(rank_in_cell AS INTEGER) AS rank_in_cell FROM r ORDER BY r.rank_in_cell, f LIMIT (SELECT greatest(1, CAST(ceil(count(*) * 0.05) AS BIGINT)) FROM {candidates} c)""")
def stratified_selection(spark, sf):
    return selection.stratified(inputs(spark, sf, "candidates"), 0.05).select("seq", "cell", "score", "rank_in_cell")


@query("""
SELECT seq, score FROM {candidates} c ORDER BY score DESC, seq LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.01 + 0.999) AS BIGINT)) FROM {candidates} c)""")
def top_percent(spark, sf):
    return selection.top_share(inputs(spark, sf, "candidates"), "score", "seq", 0.01).select("seq", "score")


@query("""
SELECT seq, cell, score FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, seq) AS i FROM {candidates} c) WHERE i <= 20""")
def top_twenty_per_cell(spark, sf):
    return selection.top_per_key(inputs(spark, sf, "candidates"), "cell", [F.desc("score"), F.asc("seq")], 20).select("seq", "cell", "score")


@query("SELECT conversation_id, language, project FROM {facts} f WHERE status = 'accepted' AND language = 'en' ORDER BY conversation_id DESC LIMIT 50 OFFSET 10")
def conversation_page(spark, sf):
    rows = selection.where_in(selection.where_equal(inputs(spark, sf, "facts"), language="en", project=None), "status", None, ["accepted"])
    return selection.page(rows, [F.desc("conversation_id")], offset=10).select("conversation_id", "language", "project")


@query("SELECT job_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY job_id DESC) AS i FROM {jobs} j) WHERE i = 1")
def latest_job(spark, sf):
    return selection.latest(inputs(spark, sf, "jobs"), "run_id", "job_id").select("job_id", "run_id", "status")


@query("""
SELECT concat(CAST(n.n_nationkey AS VARCHAR), ':', CAST(r.r_regionkey AS VARCHAR), ':', CAST(i AS VARCHAR)) AS cell_key FROM nation n, region r, range(3) t(i)""")
def run_grid(spark, sf):
    return selection.grid(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), table(spark, sf, "region").select(F.col("r_regionkey").alias("id")), 3).select("cell_key")


@query("""
SELECT 'total' AS facet, 'all' AS value, count(*) AS n FROM {facts} f UNION ALL SELECT 'language', coalesce(language, 'unknown'), count(*) FROM {facts} f GROUP BY 2
UNION ALL SELECT 'status', coalesce(status, 'unknown'), count(*) FROM {facts} f GROUP BY 2 UNION ALL SELECT 'difficulty', coalesce(difficulty, 'unknown'), count(*) FROM {facts} f GROUP BY 2""")
def freeze_stats(spark, sf):
    return datasets.freeze_stats(inputs(spark, sf, "facts"), "language", "status", "difficulty")


@query("""
SELECT conversation_id, sha256('{"messages": [' || string_agg('{"role": ' || CAST(to_json(role) AS VARCHAR) || ', "content": ' || CAST(to_json(content) AS VARCHAR) || '}', ', ' ORDER BY ordinal) || ']}') AS line
FROM {messages} m GROUP BY 1""".replace("{\"", "\x01\"").replace("\x01", "{"))
def chat_export(spark, sf):
    return datasets.chat_lines(inputs(spark, sf, "messages")).select("conversation_id", F.sha2("line", 256).alias("line"))


@query("""
SELECT CAST(l_orderkey AS BIGINT) AS conversation_id, list(DISTINCT concat(l_returnflag, l_linestatus) ORDER BY concat(l_returnflag, l_linestatus)) AS names FROM {lineitem} GROUP BY 1""")
def used_functions(spark, sf):
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    catalog = spark.createDataFrame([("NO", '{"name": "NO"}'), ("RF", '{"name": "RF"}')], "name string, definition string")
    return datasets.used_functions(calls, catalog).select("conversation_id", F.transform("functions", lambda f: f["name"]).alias("names"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM {orders}")
def upload_batches(spark, sf):
    return datasets.upload_batches(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "batch")


# --- dashboard -----------------------------------------------------------------------------------------------------


@query("SELECT status, count(*) AS n FROM {facts} f GROUP BY 1")
def status_counts(spark, sf):
    return inputs(spark, sf, "facts").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT project, count(*) AS n FROM {facts} f GROUP BY 1 ORDER BY n DESC, project LIMIT 6")
def top_projects(spark, sf):
    return dashboard.top_groups(inputs(spark, sf, "facts"), "project", 6)


@query("""
WITH l AS (SELECT CAST(max(ts) AS DATE) AS d FROM {events}), s AS (SELECT CAST(d - i AS DATE) AS day FROM l, range(14) t(i)),
c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY 1)
SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (day)""".replace("d - i", "d - CAST(i AS INTEGER)"))
def daily_events(spark, sf):
    return dashboard.daily(table(spark, sf, "events"), "ts")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'accepted') AS accepted, CAST(round(100.0 * count(*) FILTER (WHERE status = 'accepted') / count(*)) AS BIGINT) AS rate FROM {facts} f")
def acceptance_rate(spark, sf):
    return dashboard.acceptance(inputs(spark, sf, "facts"), "status", "accepted")


@query("""
SELECT n_nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def relation_counts(spark, sf):
    return dashboard.relation_counts(
        table(spark, sf, "nation").select("n_nationkey"), "n_nationkey",
        customers=table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey")), suppliers=table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey")),
    )


@query("""
WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM {events})
SELECT user_id, event_id, event_type FROM l WHERE b IS NULL OR event_type <> b""")
def changed_snapshots(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return dashboard.changed_only(events, "user_id", "at", "event_type").select("user_id", "event_id", "event_type")


@query("""
WITH a AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS s FROM {events})
SELECT event_id, user_id FROM a WHERE s IS NULL OR ts >= s""")
def since_latest_anchor(spark, sf):
    return dashboard.since_latest(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "purchase").select("event_id", "user_id")


# --- lifecycle and graphs ------------------------------------------------------------------------------------------


@query("""
SELECT run_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'succeeded') AS produced, count(*) FILTER (WHERE status = 'failed') AS failed,
  CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE status IN ('pending', 'queued', 'running')) = 0 AS complete FROM {jobs} j GROUP BY 1""")
def run_counters(spark, sf):
    return lifecycle.run_counters(inputs(spark, sf, "jobs"))


@query("SELECT job_id, CASE WHEN status = 'pending' THEN 'skipped' WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status FROM {jobs} j")
def cancelled_jobs(spark, sf):
    return inputs(spark, sf, "jobs").select("job_id", lifecycle.cancelled(F.col("status")).alias("status"))


@query("SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf):
    return lifecycle.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("""
SELECT d.doc_id AS conversation_id, CASE WHEN l.doc_id IS NOT NULL THEN 'frozen' ELSE 'deleted' END AS outcome FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def bulk_delete_outcomes(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    ids = docs.select(F.col("doc_id").alias("conversation_id"))
    return lifecycle.deletable(ids, ids, labels.select(F.col("doc_id").alias("conversation_id")))


@query("""
WITH RECURSIVE b AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth UNION SELECT e.target, b.depth + 1 FROM b JOIN {edges} e ON e.source = b.id WHERE b.depth < 3)
SELECT id, min(depth) AS depth FROM b GROUP BY 1""")
def bounded_reach(spark, sf):
    roots = spark.range(1, 2).select("id")
    return graphs.reach(inputs(spark, sf, "edges"), roots, 3)


@query("""
WITH RECURSIVE b AS (SELECT CAST(c_custkey AS BIGINT) AS id, 0 AS depth FROM {customer} WHERE c_custkey % 50 = 30
  UNION SELECT e.target, b.depth + 1 FROM b JOIN {all_edges} e ON e.source = b.id WHERE b.depth < 3)
SELECT id, min(depth) AS depth FROM b GROUP BY 1""")
def bounded_reach_all(spark, sf):
    """Over every customer, from many roots; 25 nodes lead to all customers of a nation."""
    roots = table(spark, sf, "customer").where("c_custkey % 50 = 30").select(F.col("c_custkey").cast("long").alias("id"))
    return graphs.reach(inputs(spark, sf, "all_edges"), roots, 3)


# --- text, pages, JSON ---------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query()
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query(r"""
SELECT DISTINCT page_id, CASE WHEN starts_with(l, 'http') THEN l ELSE regexp_extract(url, '^https?://[^/?#]+') || l END AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]+)["'']', 1)) AS l FROM pages) WHERE starts_with(l, '/') OR starts_with(l, 'http')""")
def page_links(spark, sf):
    """The given pages' links are whole or begin with a slash; other forms are tested against a parser of addresses."""
    return table(spark, sf, "pages").select("page_id", F.explode(text.html_links(F.col("html"), F.col("url"))).alias("link"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS tidy,
  length(text) > 5000 AS truncated FROM {documents}""".replace("\\n{3,}", "\\n\\n\\n+"))
def tidy_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.tidy(F.col("text")), 256).alias("tidy"), text.truncate(F.col("text"), 5000)["truncated"].alias("truncated"))


@query("""
SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS keyed FROM {events} GROUP BY 1""")
def event_props(spark, sf):
    data = judge.tolerant_json(F.col("props"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.try_variant_get(data, "$.k", "bigint")).alias("keyed"))


@query("""
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2""")
def windowed_events(spark, sf):
    return streams.tumbling_counts(table(spark, sf, "events"), "ts", "1 day", "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query()
def parsed_judgements(spark, sf):
    answer = F.format_string('Here: {"scores": {"accuracy": %d, "tone": %d}, "rationale": "r"}', (F.col("l_partkey") % 8).cast("int"), (F.col("l_suppkey") % 6).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", judge.parse_judge(answer, {"accuracy": 5, "tone": 5}).alias("j"))
    return rows.select("l_orderkey", "l_linenumber", F.col("j.scores")["accuracy"].alias("accuracy"), F.col("j.scores")["tone"].alias("tone"), "j.verdict", "j.parsed")


SQL["parsed_judgements"] = """
WITH s AS (SELECT l_orderkey, l_linenumber, greatest(1, least(5, l_partkey % 8)) AS accuracy, greatest(1, least(5, l_suppkey % 6)) AS tone FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(accuracy AS INTEGER) AS accuracy, CAST(tone AS INTEGER) AS tone,
  CASE WHEN least(accuracy - 1, tone - 1) / 4 >= 0.6 THEN 'pass' WHEN least(accuracy - 1, tone - 1) / 4 >= 0.3 THEN 'warn' ELSE 'fail' END AS verdict, true AS parsed FROM s"""


@query(r"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 6 AS k, l_partkey % 8 AS a, l_suppkey % 6 AS b FROM lineitem),
v AS (SELECT *, CASE k WHEN 0 THEN greatest(1, least(5, a)) WHEN 1 THEN greatest(1, least(5, a)) WHEN 2 THEN greatest(1, least(5, a)) WHEN 3 THEN 1 ELSE 0 END AS accuracy,
  CASE k WHEN 0 THEN greatest(1, least(5, b)) WHEN 1 THEN greatest(1, least(5, b)) WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS tone FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(accuracy AS INTEGER) AS accuracy, CAST(tone AS INTEGER) AS tone, k < 4 AS parsed,
  CASE WHEN k = 0 THEN 'warn' WHEN k >= 4 THEN 'fail' WHEN (least(accuracy, tone) - 1) / 4 >= 0.6 THEN 'pass' WHEN (least(accuracy, tone) - 1) / 4 >= 0.3 THEN 'warn' ELSE 'fail' END AS verdict FROM v""")
def malformed_judgements(spark, sf):
    """Fences and a verdict, quoted and fractional numbers in prose, a missing axis, a list for scores, and no JSON at all."""
    k, a, b = F.col("l_linenumber") % 6, (F.col("l_partkey") % 8).cast("int"), (F.col("l_suppkey") % 6).cast("int")
    answer = (
        F.when(k == 0, F.format_string('```json\n{"scores": {"accuracy": %d, "tone": "%d"}, "verdict": "warn"}\n```', a, b))
        .when(k == 1, F.format_string('So: {"scores": {"accuracy": %d.7, "tone": "%d"}} indeed', a, b))
        .when(k == 2, F.format_string('{"scores": {"accuracy": %d}, "verdict": "superb"}', a))
        .when(k == 3, '{"scores": [1]}')
        .when(k == 4, "no json")
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(*keys, judge.parse_judge(answer, {"accuracy": 5, "tone": 5}).alias("j"))
    return rows.select(*keys, F.col("j.scores")["accuracy"].alias("accuracy"), F.col("j.scores")["tone"].alias("tone"), "j.verdict", "j.parsed")


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'sensitive' WHEN 3 THEN 'sensitive' WHEN 1 THEN 'exfil' WHEN 4 THEN 'exfil' ELSE 'safe' END AS risk FROM part""")
def function_risk(spark, sf):
    verbs = F.array(*map(F.lit, ["create", "list", "get", "refund", "search"]))
    name = F.concat_ws("_", F.element_at(verbs, (F.col("p_partkey") % 5 + 1).cast("int")), "p_brand")
    return table(spark, sf, "part").select("p_partkey", text.risk_class(name, F.lit(None).cast("string")).alias("risk"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS key, l_linenumber % 2 AS "index", list(l_returnflag ORDER BY l_linenumber DESC, l_partkey DESC, l_returnflag DESC)[1] AS name,
  string_agg(l_linestatus, '' ORDER BY l_linenumber, l_partkey, l_linestatus) AS arguments FROM {lineitem} GROUP BY 1, 2""")
def assembled_calls(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("seq", F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey"))
    rows = line.select(F.col("l_orderkey").cast("string").alias("key"), "seq", (F.col("l_linenumber") % 2).alias("index"), F.lit(None).cast("string").alias("id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("arguments"))
    return streams.assemble_calls(rows).select("key", "index", "name", "arguments")


@query("""
SELECT c_custkey, 'Dear ' || c_name || ', ' || c_mktsegment || '!' AS greeting,
  CASE WHEN c_custkey % 4 = 0 THEN 'formal' WHEN c_custkey % 4 = 1 THEN 'colloquial' WHEN c_custkey % 4 = 2 THEN 'semi-formal' ELSE 'mixed' END AS register FROM customer""")
def rendered_prompts(spark, sf):
    c, k = F.col, F.col("c_custkey") % 4
    greeting = text.render_template(F.lit("Dear {{ name }}, {{a.segment}}{{nobody}}!"), {"name": c("c_name"), "a.segment": c("c_mktsegment")})
    register = validators.resolve_formality(F.when(k == 2, "semi-formal").otherwise("inherit"), F.when(k == 0, "baku").when(k == 1, "manglish"), F.lit("mixed"))
    return table(spark, sf, "customer").select("c_custkey", greeting.alias("greeting"), register.alias("register"))


@query("""
SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'updated' ELSE 'created' END AS action FROM supplier WHERE regexp_matches(s_name, '^[a-zA-Z_][a-zA-Z0-9_]*$')
UNION ALL SELECT s_name, 'failed' FROM supplier WHERE NOT regexp_matches(s_name, '^[a-zA-Z_][a-zA-Z0-9_]*$')""")
def import_actions(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    return datasets.import_plan(s, s.where("s_suppkey % 2 = 0"), overwrite=True)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN a > 0 AND b > 0 THEN 'TP' WHEN b > 0 THEN 'FP' WHEN a > 0 THEN 'FN' ELSE 'TN' END AS outcome
FROM (SELECT *, l_partkey % 2 AS a, l_suppkey % 2 AS b FROM lineitem)""")
def confusion_classes(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scoring.confusion(F.col("l_partkey") % 2, F.col("l_suppkey") % 2).alias("outcome"))


@query("""
SELECT l_orderkey, round(sum((l_quantity * coalesce(i, 0) + l_partkey * coalesce(o, 0)) / 1000000), 9) AS cost FROM lineitem
LEFT JOIN (VALUES ('A', 0.15, 0.60), ('N', 2.5, 10.0)) p(m, i, o) ON m = l_returnflag GROUP BY 1""")
def usage_costs(spark, sf):
    prices = spark.createDataFrame([("A", 0.15, 0.60), ("N", 2.5, 10.0)], "l_returnflag string, i double, o double")
    priced = table(spark, sf, "lineitem").join(F.broadcast(prices), "l_returnflag", "left")
    return priced.groupBy("l_orderkey").agg(F.round(F.sum(text.usage_cost(F.col("l_quantity"), F.col("l_partkey"), F.col("i"), F.col("o"))), 9).alias("cost"))


@query("SELECT list(DISTINCT coalesce(language, 'unknown') ORDER BY coalesce(language, 'unknown')) AS values FROM {facts} f")
def distinct_languages(spark, sf):
    return dashboard.distinct_values(inputs(spark, sf, "facts"), "language")


@query("""
SELECT doc_id FROM (SELECT doc_id, lower(concat_ws(' ', source, text)) AS t FROM {documents}) WHERE contains(t, 'license')""")
def text_search(spark, sf):
    return selection.search(table(spark, sf, "documents"), "LICENSE", "source", "text").select("doc_id")


from weftline.plans import checks, runs, stored, tools  # noqa: E402, F401  register their queries here
