r"""URL filters with redirect equivalence, in DataFrame functions only.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's. Of the
rules that fit a url the longest wins (host and path together; of equally long ones `allow`, then the first in text
order), and its verdict stands: an explicit allow is never overruled by what its aliases are.

Pages without a rule get the method's verdict. Redirects and canonical links make urls equivalent: the links are
`<link rel=canonical href>`, `<meta http-equiv=refresh content="n; url=...">` of each page (outside comments, scripts,
styles and texts of `noscript`, `template` and `textarea`), and the rows (source, target) of a log of redirects where
one is given. Connected components over these edges are the classes of aliases (`components`: alternating stars, no hub
meets its neighbours pairwise); a class with a url that a rule blocks is blocked, whether or not that url is a page of
the table. Members with an allow rule of their own stay allowed, and do not clear the others.

Urls are compared in the form that `resolve_link` gives: scheme and host in lower case, no default port, no dot steps,
no fragment, `/` for an empty path; the query counts. Only http and https urls have aliases. The html is read once; only
a page's id, url parts and links leave the scan, and only linked pages enter the rounds of `components`.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and is allowed. Null or empty html has no links. Each
row of `pages` gives one row, repeated rows and null ids too; rows of one url share their links. Links to the page
itself count for nothing; an attribute's value ends at `>`. Other columns of `pages` are left alone, whatever they are
called. An empty table gives no rows. The rules are part of the plan, a list of up to some thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import resolve_link
from weftline.llm.components import components
from weftline.llm.staging import stage

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TAG = r"(?i)<(?:link|meta)[\s/][^>]*>"
HIDDEN = ("script", "style", "noscript", "template", "textarea")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def winning_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The rule (verdict, rule) that wins, or null."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0], r[1] + r[2]))
    if not ranked:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    table = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in ranked])
    fits = lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])
    first = F.try_element_at(F.filter(table, fits), F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["verdict"].alias("verdict"), F.concat(first["host"], first["path"]).alias("rule")))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.replace(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]), F.lit("&amp;"), F.lit("&"))


def link_targets(html: Column, node: Column) -> Column:
    """The urls that a page says it is at: its canonical links and refreshes, distinct, without itself."""
    shown = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in HIDDEN:
        shown = F.regexp_replace(shown, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    tags = F.regexp_extract_all(shown, F.lit(TAG), F.lit(0))

    def target(tag: Column) -> Column:
        link = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
        refresh = F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"
        # The quote that may open the address closes it again.
        inside = F.regexp_extract(_attribute(tag, "content"), r"(?i)^\s*[\d.]+\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
        return F.when(tag.rlike(r"(?i)^<link") & link, _attribute(tag, "href")).when(tag.rlike(r"(?i)^<meta") & refresh, inside)

    found = F.filter(F.transform(tags, target), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    urls = F.filter(F.transform(found, lambda x: resolve_link(x, node)), lambda x: x.isNotNull() & (x != node))
    none = F.array().cast("array<string>")
    return F.when(html.rlike(r"(?i)\bcanonical\b|http-equiv\s*=\s*[\"']?\s*refresh"), F.coalesce(F.array_distinct(urls), none)).otherwise(none)


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, alias_class), one for each row of `pages` (page_id, url, html).

    alias_class is the least url of the page's class, null for a page without aliases.
    """
    host, path = host_and_path(F.col("url"))
    node = resolve_link(F.col("url"), F.lit(""))
    slim = pages.select("page_id", host.alias("host"), path.alias("path"), node.alias("node"), "html")
    slim = slim.select("page_id", "host", "path", "node", winning_rule(F.col("host"), F.col("path"), rules).alias("own"), link_targets(F.col("html"), F.col("node")).alias("targets"))
    slim = stage(slim, "pages")
    edges = slim.where("node IS NOT NULL").select(F.col("node").alias("a"), F.explode("targets").alias("b"))
    if redirects is not None:
        ends = [resolve_link(F.col(c), F.lit("")).alias(n) for c, n in (("source", "a"), ("target", "b"))]
        edges = edges.unionAll(redirects.select(*ends).where("a IS NOT NULL AND b IS NOT NULL"))
    classes = components(edges)
    judged = lambda url: F.coalesce(winning_rule(*host_and_path(url), rules)["verdict"] == "block", F.lit(False))
    # A rule can fit a url as it is written and not its resolved form.
    odd = slim.where((F.col("own.verdict") == "block") & ~judged(F.col("node"))).select("node").distinct()
    blocked = classes.where(judged(F.col("node"))).select("label").unionAll(classes.join(odd, "node", "left_semi").select("label")).distinct()
    marked = classes.join(blocked.withColumn("bad", F.lit(True)), "label", "left").select(F.col("node").alias("alias"), "label", "bad")
    rows = slim.join(marked, F.col("node") == F.col("alias"), "left")
    verdict = F.coalesce("own.verdict", F.when(F.col("bad"), "block"), F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), F.col("label").alias("alias_class"))
