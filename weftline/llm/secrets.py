r"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong kinds are reported wherever they stand: `assign` (a named password, token or key), `access` (AKIA
identifiers) and `hex` (24 hex digits or more). Weak parts mean little alone: `ident` (a named user or key id), `blob`
(20 or more base64 characters with a digit, an upper- and a lower-case letter) and `endpoint` (a URL). They are linked
by an interval join within scopes of `SCOPE` code points of one document, done as a range window, so parts are never
paired: an identifier is reported when a secret lies in its scope, a blob when an identifier does, an endpoint when
both do. `assign`, `hex` and `blob` count as secrets, `access` and `ident` as identifiers.

Only offsets leave the scan: texts are split at the matches, and running sums of the pieces' lengths (a window over
the few documents with matches) give starts and ends in code points. Documents are keyed by (doc_id, text hash), so
repeated rows are scanned once and reported alike. A null text is empty; a null doc_id is a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.staging import stage
from weftline.llm.text import whole

SCOPE = 200
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
SECRET, IDENTIFIER = ("assign", "hex", "blob"), ("access", "ident")


def either_case(word: str) -> str:
    """A pattern of `word` with ASCII letters in either case, alike in every regular-expression engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = ["password", "passwd", "secret", "token"]
ASSIGN = "(" + "|".join(map(either_case, _NAMES)) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
_LOGINS = ["username", "user", "login", "account", "client_id", "access_key_id", "key_id"]
IDENT = "(" + "|".join(map(either_case, _LOGINS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
BLOB_CHARS = "A-Za-z0-9+/_=-"
#: Runs of 20 characters or more that hold a digit, an upper- and a lower-case letter; tried at a run's start only.
BLOB = rf"(?<![{BLOB_CHARS}])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[{BLOB_CHARS}]{{20,}}"
ENDPOINT = r"[a-z]+://[A-Za-z0-9._:@/-]+"


def _found(text: Column, kind: str, pattern: str, gate: Column | None = None, group: int = 0, least: int = 0) -> Column:
    """All matches as (kind, i, gap since the last match, length, whether it counts)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    # The pieces outnumber the matches by one; the last piece pairs with null and is dropped.
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), matches.alias("hit"), value.alias("value"))
    both = F.filter(both, lambda x: x["hit"].isNotNull())

    def row(x: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["piece"]).alias("gap"), F.length(x["hit"]).alias("len"), (F.length(x["value"]) >= least).alias("counts"))

    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,counts:boolean>>")
    seen = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(seen, F.transform(both, row)).otherwise(none)


def find_parts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, th, hits), one for each row of `docs`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assigns = text.contains("=") | text.contains(":")
    hits = F.concat(
        _found(text, "assign", ASSIGN, assigns, 2, 6),
        _found(text, "access", ACCESS, text.contains("AKIA")),
        _found(text, "hex", HEX),
        _found(text, "ident", IDENT, assigns, 2, 3),
        _found(text, "blob", BLOB),
        _found(text, "endpoint", ENDPOINT, text.contains("://")),
    )
    return docs.select("doc_id", F.xxhash64("text").alias("th"), hits.alias("hits"))


def link_parts(found: DataFrame) -> DataFrame:
    """Rows (doc_id, th, kind, rank, start, end) of all spans reported, from `find_parts`' rows."""
    parts = found.where(F.size("hits") > 0).select("doc_id", "th", F.inline("hits")).distinct()
    one = W.partitionBy("doc_id", "th", "kind").orderBy("i")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(one)).withColumn("start", F.col("end") - F.col("len"))
    parts = parts.where("counts")
    scope = W.partitionBy("doc_id", "th").orderBy("start").rangeBetween(-SCOPE, SCOPE)
    near = lambda kinds: F.max(F.col("kind").isin(*kinds)).over(scope)
    parts = parts.withColumns({"secret": near(SECRET), "identifier": near(IDENTIFIER)})
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    linked = (
        F.col("kind").isin("assign", "access", "hex")
        | ((F.col("kind") == "ident") & F.col("secret"))
        | ((F.col("kind") == "blob") & F.col("identifier"))
        | ((F.col("kind") == "endpoint") & F.col("secret") & F.col("identifier"))
    )
    return parts.where(linked).select("doc_id", "th", "kind", rank.alias("rank"), "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans), one for each row of `docs`; spans are (start, rank, kind, end), in order."""
    found = stage(find_parts(docs), "parts")
    spans = link_parts(found).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    rows = found.select("doc_id", "th").alias("f").join(spans.alias("s"), F.expr("f.doc_id <=> s.doc_id AND f.th = s.th"), "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("f.doc_id", F.coalesce("spans", none).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows of `docs` with `mask` in place of every run of reported spans; n_chars follows where it exists."""
    spans = link_parts(stage(find_parts(docs), "parts"))
    order = W.partitionBy("doc_id", "th").orderBy("start", "rank")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1))
    runs = spans.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "th", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    before = F.coalesce(F.lag("end").over(W.partitionBy("doc_id", "th").orderBy("start")), F.lit(0))
    runs = runs.withColumn("before", before).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "before"))).alias("__runs"))
    rows = docs.select(whole(docs).alias("doc"), F.xxhash64("text").alias("text_hash")).alias("d")
    rows = rows.join(runs.alias("r"), F.expr("d.doc.doc_id <=> r.doc_id AND d.text_hash = r.th"), "left")
    text = F.col("d.doc.text")
    pieces = F.transform("__runs", lambda x: F.substring(text, x["before"].cast("int") + 1, (x["start"] - x["before"]).cast("int")))
    rest = F.substring(text, F.element_at("__runs", -1)["end"].cast("int") + 1, F.length(text))
    masked = F.when(F.col("__runs").isNull(), text).otherwise(F.concat(F.array_join(F.concat(pieces, F.array(rest)), mask)))
    columns = [masked.alias(c) if c == "text" else F.col(f"d.doc.`{c}`").alias(c) for c in docs.columns]
    rows = rows.select(*columns)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows
