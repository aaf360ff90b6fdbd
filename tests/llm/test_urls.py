"""URL filters against a plain walk over the links, and on odd rows."""

from __future__ import annotations

import random
from urllib.parse import urljoin

import pytest

from weftline.llm import queries, urls

PAGE = "page_id long, url string, html string"


def plain_rule(host, path):
    fit = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return min(fit, key=lambda r: (-len(r[1] + r[2]), r[0]), default=None)


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[end:].split("?")[0].split("#")[0]
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path


def brute(rows):
    """rows: (page_id, url, [absolute targets])."""
    near = {}
    for _, url, targets in rows:
        for t in targets:
            near.setdefault(url, set()).add(t)
            near.setdefault(t, set()).add(url)
    out = []
    for page, url, _ in rows:
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        seen, todo = {url}, [url]
        while todo:
            for x in near.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        bad = any((r := plain_rule(*plain_parts(x))) and r[0] == "block" for x in seen)
        verdict = rule[0] if rule else "block" if bad else "allow"
        out.append((page, host, path, rule and rule[1] + rule[2], verdict, min(seen) if len(seen) > 1 else None))
    return sorted(out)


def tag(target, kind):
    return (
        f'<head><link rel="canonical" href="{target}"></head>',
        f"<LINK href='{target}' rel='nofollow Canonical' />",
        f'<meta http-equiv="refresh" content="0; url={target}">',
        f"<meta content=\"3;URL='{target}'\" http-equiv=Refresh>",
    )[kind]


@pytest.mark.parametrize("seed", range(3))
def test_blocks_reach_every_alias(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.example.com", "m.example.net", "x.org", "example.org", "other.io", "b.example.net"]
    names = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'es', 'en'])}/{i}" for i in range(120)]
    rows, pages = [], []
    for i, url in enumerate(names):
        targets = [rng.choice(names) for _ in range(rng.choice([0, 0, 1, 2]))] + (["http://hub.io/one"] if i % 3 == 0 else [])
        rows.append((i, url, [t for t in targets if t != url]))
        pages.append((i, url, "<p>x</p>".join(tag(t, rng.randrange(4)) for t in targets)))
    got = urls.judge(spark.createDataFrame(pages, PAGE)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_an_allow_rule_stands_and_clears_nobody(spark):
    pages = [
        (1, "http://a.com/de/1", ""), (2, "http://a.org/x", tag("http://a.com/de/1", 0)), (3, "http://a.net/y", tag("http://a.org/x", 2)),
        (4, "http://b.net/z", tag("http://c.net/gone", 0)), (5, "http://d.net/", ""),
    ]
    log = spark.createDataFrame([("http://c.net/gone", "http://A.com:80/de/../de/1#f"), (None, "http://d.net/")], "source string, target string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, PAGE), redirects=log).collect()}
    assert got == {1: ("com/de/", "block"), 2: ("org/", "allow"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow")}


@pytest.mark.parametrize("link", ["/de/1", "../de/1", "//h.com/de/1", "?q=1", "http://h.com/de/1?a=1&amp;b=2#x", "x", "./", ""])
def test_links_are_resolved(spark, link):
    page = "http://h.com/fr/2?z=1"
    row = urls.judge(spark.createDataFrame([(1, page, tag(link, 0))], PAGE)).first()
    want = urljoin(page, link.replace("&amp;", "&")).split("#")[0]
    assert row.alias_class == (None if not link or want == page else min(page, want))


def test_links_that_do_not_count(spark):
    html = [
        "<!-- " + tag("http://b.com/de/", 0) + " -->", "<script>var t = '" + tag("http://b.com/de/", 1) + "'</script>", '<link rel="next" href="http://b.com/de/">',
        '<meta name="canonical" content="0; url=http://b.com/de/">', tag("mailto:x@b.com", 0), tag("http://a.net/", 0), "<a href='http://b.com/de/'>canonical</a>",
    ]
    rows = urls.judge(spark.createDataFrame([(i, "http://a.net/", h) for i, h in enumerate(html)], PAGE)).collect()
    assert {(r.verdict, r.alias_class) for r in rows} == {("allow", None)}


def test_odd_rows(spark):
    rows = [
        (None, None, None), (1, "", ""), (2, "no scheme/de/", tag("http://b.com/de/", 0)), (3, "HTTP://A.B.COM/de/x", None), (3, "HTTP://A.B.COM/de/x", None),
        (4, "http://x.org", ""), (5, "ftp://x.org/?q", ""), (6, "http://com/de/", "x" * 500_000), (7, "http://acom/de/", ""), (8, "a://b://c.com/de/", ""),
        (9, "http://É.COM/fr/", ""),
    ]
    pages = spark.createDataFrame([(*r, "n", 0, "b") for r in rows], PAGE + ", node string, label int, bad string")
    got = urls.judge(pages).collect()
    want = []
    for page, url, _ in rows:
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        want.append((page, host, path, rule and rule[1] + rule[2], rule[0] if rule else "allow", None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules=()).collect()} == {"allow"}


def test_sql_of_linked_pages(spark, tmp_path, duck):
    pages = [
        (1, "http://a.com/de/1", ""), (2, "http://a.org/x", tag("http://a.com/de/1", 0)), (3, "http://a.net/y", tag("http://a.org/x", 2)), (4, "http://b.net/z", tag("/w", 0)),
        (None, None, None), (4, "http://b.net/z", tag("/w", 0)), (5, "https://B.net:443/w#q", ""),
    ]
    spark.createDataFrame(pages, PAGE).write.parquet(f"{tmp_path}/pages.parquet")
    sql = queries.SQL["op11_url_filter"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(sql).fetchall()
    got = queries.op11_url_filter(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and {r.verdict for r in got if r.rule is None} == {"allow", "block"}
