"""Edge cases that the driver's tables do not hold."""

from __future__ import annotations

import difflib
import hashlib
import json
import random
import re
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from weftline.functions import judge, similarity, text, toolcalls
from weftline.operators import blocks, dashboard, datasets, exports, graphs, lifecycle, linting, runs, scoring, selection, validators
from weftline.plans import registry
from weftline.session import table
from weftline.sources import readers, sinks
from weftline.streaming import events


def one(spark, column, **values):
    names, row = list(values), [list(values.values())]
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'long'}" for n, v in values.items())
    return spark.createDataFrame(row, schema).select(column.alias("x")).first()["x"] if names else None


def test_blocks_drop_what_precedes_the_first_user(spark):
    rows = [("a", 0, "system", "s"), ("a", 1, "assistant", "x"), ("a", 2, "user", "u"), ("a", 3, "tool", None), ("a", 4, "user", ""), ("b", 0, "system", "s")]
    m = spark.createDataFrame(rows, "conversation_id string, ordinal int, role string, content string")
    assert {(r.ordinal, r.block) for r in blocks.with_blocks(m).collect()} == {(2, 1), (3, 1), (4, 2)}
    assert {r.ordinal for r in blocks.with_blocks(m, first_only=True).collect()} == {2, 3}
    assert blocks.closing_replies(m).first()["reply"] == "x"


def test_budget_keeps_the_first_and_stops(spark):
    rows = [("g", 0, "a" * 9), ("g", 1, "b" * 9), ("g", 2, "c")]
    got = blocks.budgeted(spark.createDataFrame(rows, "`group` string, place int, text string"), limit=5, each=9).first()
    assert (got["kept"], got["omitted"], got["text"]) == (1, 2, "a" * 9)


@pytest.mark.parametrize(("words", "verdict"), [(["a"] * 29, "pass"), (["a"] * 30, "fail"), ([f"w{i}" for i in range(40)], "pass")])
def test_repetition(spark, words, verdict):
    got = validators.repetition(spark.createDataFrame([("c", " ".join(words))], "conversation_id string, text string")).first()
    assert got["verdict"] == verdict


def test_repetition_of_nothing(spark):
    got = validators.repetition(spark.createDataFrame([("c", None), ("d", "")], "conversation_id string, text string")).collect()
    assert {(r.verdict, r.score) for r in got} == {("pass", 1.0)}


def test_particles_stand_at_word_bounds(spark):
    df = spark.createDataFrame([("Okay LAH, foo_lah eh",)], "t string")
    assert df.select(validators.word_hits(F.col("t"), validators.PARTICLES)).first()[0] == ["lah", "eh"]


@pytest.mark.parametrize(
    ("raw", "scores", "verdict"),
    [
        ('```json\n{"scores": {"a": 9, "b": "4"}, "verdict": "warn"}\n```', {"a": 5, "b": 4}, "warn"),
        ('So: {"scores": {"a": 0, "b": 4.7}}', {"a": 1, "b": 4}, "fail"),
        ("no json", {"a": 0, "b": 0}, "fail"),
        ('{"scores": [1]}', {"a": 1, "b": 1}, "fail"),
        ('{"scores": {"a": 5, "b": 4}}', {"a": 5, "b": 4}, "pass"),
        (None, {"a": 0, "b": 0}, "fail"),
    ],
)
def test_judge_answers(spark, raw, scores, verdict):
    got = spark.createDataFrame([(raw,)], "t string").select(judge.parse_judge(F.col("t"), {"a": 5, "b": 5}).alias("j")).first()["j"]
    assert (got["scores"], got["verdict"]) == (scores, verdict)


def test_tolerant_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('"{\\"a\\": 1}"',), ("{",), (None,)], "t string")
    got = df.select(F.to_json(judge.tolerant_json(F.col("t"))).alias("j")).collect()
    assert [r.j for r in got] == ['{"a":1}', '{"a":1}', None, None]


def test_similarity_is_strict_and_accuracy_is_not(spark):
    assert similarity.similarity(1, 1.0) == 0.0
    assert similarity.similarity({"a": "Foo", "b": [1, 2]}, {"a": "foo", "b": [1]}) == pytest.approx(0.75)
    assert similarity.similarity("abcd", "bcde") == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()
    df = spark.createDataFrame([('{"a": 1, "b": "x"}', '{"a": 1.0}'), ("{}", "bad"), (None, None)], "e string, p string")
    got = df.select(similarity.parameter_accuracy("e", "p").alias("r"), similarity.argument_similarity("e", "p").alias("s")).collect()
    assert [(r.r["correct"], r.r["total"], r.r["accuracy"]) for r in got] == [(1, 2, 0.5), (0, 0, 1.0), (0, 0, 1.0)]



def test_only_texts_that_share_characters_are_matched(monkeypatch):
    """Of equal texts and of texts without a common character the ratio is known; the others have difflib's."""
    rng = random.Random(7)
    texts = ["", "a", *("".join(rng.choices("abxyz"[i % 4 :], k=rng.choice((1, 3, 250)))) for i in range(24))]
    matcher, searched = difflib.SequenceMatcher, []
    monkeypatch.setattr(similarity.difflib, "SequenceMatcher", lambda *given: searched.append(given[1:]) or matcher(*given))
    for a in texts:
        for b in texts:
            assert similarity.similarity({"t": a}, {"t": b}) == matcher(None, a, b).ratio()
    assert searched and all(a != b and set(a) & set(b) for a, b in searched)

def test_two_medians(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (1, "a", 4.0)], "item int, axis string, score double")
    v = spark.createDataFrame([(1, "odd"), (1, "warn")], "item int, verdict string")
    assert scoring.consensus(s, ["item"]).first()["score"] == 1.0
    got = scoring.ensemble(s, v, ["item"]).first()
    assert (got["medians"], got["max_spread"], got["verdict"]) == ({"a": 2.5}, 3.0, "warn")


def test_stratified_counts_before_dedup(spark):
    rows = [(i, float(i % 5), f"c{i % 3}", 7 if i < 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "seq int, score double, cell string, hash int")
    got = selection.stratified(df, 0.5).collect()
    assert len(got) == 10 and sum(r.hash == 7 for r in got) <= 1
    assert selection.stratified(df.limit(0), 0.5).count() == 0
    assert selection.top_share(df, "score", "seq", 1e-9).count() == 1


def test_versions(spark):
    make = lambda *v: datasets.next_version(spark.createDataFrame([(x,) for x in v], "version string")).first()["version"]
    assert make("0.1.9", "0.1.10", "odd") == "0.1.11"
    assert make() == "0.1.0"


def test_export_line(spark):
    m = spark.createDataFrame([("c", 1, "assistant", None), ("c", 0, "user", 'é "x"\n')], "conversation_id string, ordinal int, role string, content string")
    assert datasets.chat_lines(m).first()["line"] == '{"messages": [{"role": "user", "content": "é \\"x\\"\\n"}, {"role": "assistant"}]}'


def test_written_lines(spark, tmp_path):
    m = spark.createDataFrame([("c", 0, "user", "x"), ("d", 0, "user", "é")], "conversation_id string, ordinal int, role string, content string")
    got = sinks.write_chat_lines(m, str(tmp_path / "out")).first()
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert got["rows"] == 2 and got["bytes"] == sum(len(x.encode()) + 1 for x in lines)


def test_template(spark):
    df = spark.createDataFrame([("Hi {{ name }}, {{a.b}}{{none}}!", "{{a.b}}", "z")], "t string, n string, v string")
    assert df.select(text.render_template(F.col("t"), {"name": F.col("n"), "a.b": F.col("v")})).first()[0] == "Hi {{a.b}}, z!"


def plain_scrub(raw):
    for pattern, put in [
        (r"\*\*([^*]+?)\*\*", r"\1"), (r"\b_([^_]+?)_\b", r"\1"), (r"(?<!\*)\*([^*]+?)\*(?!\*)", r"\1"), (r"`([^`]+?)`", r"\1"),
        (r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", "[…]"), (r" {2,}", " "),
    ]:
        raw = re.sub(pattern, put, raw, flags=re.ASCII)
    return raw.strip(" ")


def test_scrub_over_all_documents(spark, tmp_path):
    raw = ["**bold** and *slanted*", "_slanted_ snake_case_name  `code`", "a * b ** c *", "***x*** y_z", "plain", "", None]
    spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.scrubbed for r in registry.QUERIES["scrubbed_all_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: None if x is None else hashlib.sha256(plain_scrub(x).encode()).hexdigest() for i, x in enumerate(raw)}


@pytest.mark.parametrize(("raw", "clean"), [("do **it** for my_fn_name  now", "do it for […] now"), ("`x` and *y* _z_", "x and y z"), ("", "")])
def test_scrub(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(text.scrub(F.col("t"))).first()[0] == clean


def test_links(spark):
    html = """<a href="/a">1</a><A class=x href='b?q'>2</A><a href="b#f">3</a><a href=/bare>4</a><a href="https://x.org:443/c">5</a><a href="mailto:q">6</a><a href="/a">7</a><abbr href="/n">"""
    df = spark.createDataFrame([(html, "http://h.org/d/e"), (None, "http://h.org/")], "h string, u string")
    got = [r[0] for r in df.select(text.html_links(F.col("h"), F.col("u"))).collect()]
    assert got == [["http://h.org/a", "http://h.org/d/b?q", "https://x.org/c"], []]


def test_links_of_all_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.l for r in pages.select("page_id", text.html_links(F.col("html"), F.col("url")).alias("l")).collect()}
    rule = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)["']""", re.I)
    n = 0
    for r in pages.collect():
        want = [urljoin(r.url.split("#")[0], x) for x in rule.findall(r.html or "")]
        assert got[r.page_id] == list(dict.fromkeys(x for x in want if x.startswith("http")))
        n += len(want)
    assert n > 1000


class PlainText(HTMLParser):
    """The text of a page by a parser, by the same rules."""

    SKIPPED, BLOCKS = ("script", "style", "nav", "footer", "head"), ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "section", "article")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.inside.append(tag)
        elif tag == "br" and not self.inside:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside = self.inside[: self.inside.index(tag)]
        elif tag in self.BLOCKS and not self.inside:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)


def test_text_of_all_pages(spark):
    """Every page of the table against a parser; runs of blanks count as one."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    words = lambda t: [" ".join(x.split()) for x in t.split("\n") if x.strip()]
    for r in pages.select("html", text.html_text(F.col("html")).alias("t")).collect():
        parser = PlainText()
        parser.feed(r.html or "")
        parser.close()
        assert words(r.t) == words("".join(parser.out))


def test_changes_of_one_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1), (2, None, 1)], "k int, v string, at int")
    assert sorted(map(tuple, runs.upsert(rows, changes, "k", "at").collect())) == [(1, "x"), (2, "b"), (3, "z")]
    with pytest.raises(Exception, match="several changes of the key 1"):
        runs.upsert(rows, changes, "k").collect()


def test_null_snapshots_change_once(spark):
    df = spark.createDataFrame([("k", 0, None), ("k", 1, None), ("k", 2, "a"), ("k", 3, None)], "key string, at int, s string")
    assert sorted(r.at for r in dashboard.changed_only(df, "key", "at", "s").collect()) == [0, 2, 3]


def test_graph_cleaning_and_layers(spark):
    nodes = spark.createDataFrame([("s", "start", 0), ("s", "intent", 1), ("t", "start", 2), ("u", "end", 3), ("o", "end", 4)], "id string, kind string, place int")
    edges = spark.createDataFrame([("s", "t", 0), ("t", "u", 1), ("s", "u", 2), ("u", "x", 3)], "source string, target string, place int")
    n, e = graphs.clean_graph(nodes, edges)
    assert {(r.id, r.kind) for r in n.collect()} == {("s", "start"), ("t", "intent"), ("u", "end"), ("o", "end")}
    assert e.count() == 3
    assert {(r.id, r.depth) for r in graphs.layers(n, e, "s").collect()} == {("s", 0), ("t", 1), ("u", 2), ("o", 3)}


def test_walks_stop(spark):
    nodes = spark.createDataFrame([("a", "condition", None), ("b", "action", None), ("c", "end", None), ("g", "condition", 1)], "id string, kind string, max_attempts int")
    edges = spark.createDataFrame(
        [("a", "b", 0, "x"), ("a", "c", 1, "y"), ("b", "a", 0, "z"), ("g", "g", 0, "again"), ("g", "c", 1, "Give_Up")], "source string, target string, place int, label string"
    )
    starts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "g"), (4, "c")], "walk int, node string")
    choices = spark.createDataFrame([(2, 0, "y"), (1, 2, "none such")], "walk int, step int, label string")
    got = sorted(map(tuple, graphs.walk(nodes, edges, choices, starts, max_steps=5, max_visits=2).collect()))
    assert got == [
        (1, 0, "a", 1, "x", "unchosen"), (1, 1, "b", 1, "z", "first"), (1, 2, "a", 2, "x", "unknown"), (1, 3, "b", 2, "z", "guard"),
        (2, 0, "a", 1, "y", "chosen"), (2, 1, "c", 1, None, "end"), (3, 0, "g", 1, "again", "unchosen"), (3, 1, "g", 2, "Give_Up", "exhausted"),
        (3, 2, "c", 1, None, "end"), (4, 0, "c", 1, None, "end"),
    ]


def test_delete_outcomes(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "conversation_id int")
    got = lifecycle.deletable(ids, ids.where("conversation_id < 3"), ids.where("conversation_id = 2"))
    assert {tuple(r) for r in got.collect()} == {(1, "deleted"), (2, "frozen"), (3, "missing")}


def test_files(spark, tmp_path):
    (tmp_path / "10.json").write_text('{"conversation_id": "b", "messages": [{"role": "user", "content": "x"}], "metadata": {"n": 1}}')
    (tmp_path / "9.json").write_text('{"conversation_id": "a", "messages": []}')
    (tmp_path / "z.json").write_text("{bad")
    assert [r.conversation_id for r in readers.conversation_files(spark, str(tmp_path)).collect()] == ["a", "b"]


def test_checkpoint_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"conversation_id": "a", "n": 1}\nbad\n{"conversation_id": "a", "n": 2}\n')
    got = readers.checkpoint_lines(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r.conversation_id, r.line) for r in got] == [("a", '{"conversation_id":"a","n":2}')]


def test_call_fragments(spark):
    rows = [("k", 0, 0, "id1", "fn", '{"a"'), ("k", 2, 0, None, None, ": 1}"), ("k", 1, 1, "id2", "g", None)]
    df = spark.createDataFrame(rows, "key string, seq int, index int, id string, name string, arguments string")
    assert {tuple(r) for r in events.assemble_calls(df).collect()} == {("k", 0, "id1", "fn", '{"a": 1}'), ("k", 1, "id2", "g", "")}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ['{"key": "r", "seq": 1, "event": "item.done", "payload": "{\\"tokens\\": 3}"}', '{"key": null, "event": "x"}', '{"key": "r", "seq": 2, "event": "done", "payload": "\\"{\\\\\\"tokens\\\\\\": 4}\\""}']
    (folder / "a.json").write_text("\n".join(lines))
    stream = events.live_metrics(events.read_events(spark, str(folder)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.live_metrics(events.well_formed(spark.read.schema(events.EVENT).json(str(folder))))
    assert [tuple(r) for r in spark.table("live").collect()] == [tuple(r) for r in batch.collect()] == [("r", 1, 0, 7, True)]


def test_calls_of_fragments_with_one_number(spark):
    rows = [("k", 1, 0, None, "b", "x"), ("k", 1, 0, None, "a", "y"), ("k", 2, 0, "7", None, None), ("k", 1, 1, None, None, None)]
    df = spark.createDataFrame(rows, "key string, seq long, index int, id string, name string, arguments string")
    for order in (df, df.orderBy("name"), df.orderBy(F.desc("name"))):
        got = {(r.key, r["index"]): (r.id, r.name, r.arguments) for r in events.assemble_calls(order).collect()}
        assert got == {("k", 0): ("7", "b", "xy"), ("k", 1): (None, None, "")}


def test_buffer_counts_in_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(f'{{"key": "k", "seq": {i}, "event": "{"restart" if i == 4 else "delta"}", "payload": "{{}}"}}' for i in range(6)))
    stream = events.buffered(events.read_events(spark, str(folder)), most=2)
    q = stream.writeStream.outputMode("append").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    # A stream with timeouts by processing time never ends by itself.
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and spark.table("kept").count() < 6:
            time.sleep(0.2)
    finally:
        q.stop()
    assert [(r.seq, r.kept) for r in spark.table("kept").orderBy("seq").collect()] == [(0, True), (1, True), (2, False), (3, False), (4, True), (5, True)]


CALLS = "conversation_id string, ordinal int, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"


def test_lint_of_transcripts(spark):
    rows = [
        ("c", 0, "user", "Encik, hi", None, None), ("c", 1, "assistant", "", [("1", "f", "{}"), ("2", "g", "{bad")], None),
        ("c", 2, "tool", '{"error": {"http_status": 500}}', None, "1"), ("c", 3, "tool", "no", None, "9"), ("d", 0, "user", "tak", None, None),
    ]
    m = spark.createDataFrame(rows, CALLS)
    got = {(r.conversation_id, r.rule, r.detail) for r in linting.lint_transcripts(m, spark.createDataFrame([("f",)], "name string"), ("tak",), (1, 2), 2).collect()}
    assert got == {
        ("c", "unknown_function", "g"), ("c", "arguments_not_json", "g"), ("c", "content_not_json", None), ("c", "unpaired_result", "9"),
        ("d", "no_vocative", None), ("d", "few_functions", "0"), ("d", "forbidden", "tak"),
    }
    meta = {r.conversation_id: (r.user_turns, r.max_parallel, r.api_errors, r.functions) for r in linting.transcript_metadata(m).collect()}
    assert meta == {"c": (1, 2, 1, ["f", "g"]), "d": (1, 0, 0, None)}


def test_ids_and_parameters(spark):
    parameters = '{"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "string"}, "c": {"type": "number"}}}'
    df = spark.createDataFrame([('{"a": true, "b": 3, "c": 1.5, "z": 1}', parameters, '{"order_id": "AB-123", "x": "has a-blank y", "id": "7"}'), ("bad", "{}", "bad")], "a string, p string, t string")
    c = F.col
    got = df.select(
        linting.required_coverage(c("a"), c("p")).alias("r"), linting.type_accuracy(c("a"), c("p")).alias("t"), linting.harvested_ids(c("t")).alias("h"),
        F.transform(linting.keyed_ids(c("t")), lambda x: F.concat_ws("=", x["key"], x["value"])).alias("k"), linting.id_propagation(linting.harvested_ids(c("t")), F.lit("AB-123"), F.lit("-")).alias("p"),
    ).collect()
    assert [(r.r, round(r.t, 3), r.h, r.k, r.p) for r in got] == [(1.0, 0.667, ["AB-123"], ["order_id=AB-123", "id=7"], 0.0), (1.0, 1.0, [], [], None)]


def test_lint_of_libraries(spark):
    fns = spark.createDataFrame([("l", "f", "d", "s", "r", '{"type": "object", "x": "#/shared_entities/e/y"}'), ("l", "f", None, "s", "r", "{}")], "library string, name string, description string, stage string, returns string, parameters string")
    got = {(r.rule, r.detail) for r in linting.lint_library(fns, spark.createDataFrame([("l", "g")], "library string, name string"), spark.createDataFrame([("l", "o")], "library string, key string")).collect()}
    assert got == {("function_count", "2"), ("missing_field", "f"), ("parameters_type", "f"), ("duplicate_name", "f"), ("dangling_ref", "e"), ("original_lost", "g")}


def test_style_guide(spark):
    df = spark.createDataFrame([("formal", "ms", True, False, "forbid", ["x"]), ("colloquial", "en", False, True, "allowlist", [])], "r string, p string, f boolean, a boolean, l string, w array<string>")
    got = [r[0] for r in df.select(text.style_guide(*map(F.col, "rpfalw"))).collect()]
    assert got[0].startswith("Respond in Formal Malay. Use full") and got[0].endswith("Translate all technical terms.")
    assert got[1] == "Respond in a casual, conversational Malaysian register."


@pytest.mark.parametrize(
    ("raw", "names", "content"),
    [
        ('Hi [TOOL_CALLS][{"name": "f", "arguments": {"a": "]"}}] bye', ["f"], "Hi  bye"),
        ('[TOOL_CALLS]f{"a": "}"} g {"b": 1}', ["f", "g"], ""),
        ('x <tool_call>{"name": "f"}</tool_call> y', ["f"], "x  y"),
        ("[TOOL_CALLS][bad", [], "[TOOL_CALLS][bad"), ("plain", [], "plain"), (None, [], None), ("[TOOL_CALLS]", [], "[TOOL_CALLS]"),
    ],
)
def test_calls_in_text(spark, raw, names, content):
    got = spark.createDataFrame([(raw,)], "t string").select(toolcalls.parse_inline_calls("t").alias("p")).first()["p"]
    assert ([c["name"] for c in got["calls"]], got["content"]) == (names, content)


def test_stored_calls_and_references(spark):
    rows = [('[{"name": "f", "arguments": {"a": 1}}, {"id": "7", "function": {"name": "g", "arguments": "{}"}}, {"id": "8"}]',), ("bad",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(toolcalls.stored_calls(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in got] == [[("", "f", '{"a":1}'), ("7", "g", "{}")], [], []]
    refs = spark.createDataFrame([('{"x": {"$ref": "#/shared_entities/e"}}', '{"e": {"y": [{"$ref": "#/shared_entities/e"}]}}')], "s string, e string")
    assert refs.select(toolcalls.resolve_references("s", "e").alias("r")).first()["r"] == '{"x": {"y": [{"$ref": "#/shared_entities/e"}]}}'


def test_batches_over_many_partitions(spark):
    """Numbers follow the order on a table in 8 partitions with repeats and nulls, whatever the parts."""
    keys = [None, None, *[7] * 500, *range(3000)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(8)
    got = sorted(datasets.upload_batches(df, "k", part_rows=300).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(keys))) and [r.batch for r in got] == [i // 100 for i in range(len(keys))]
    assert [r.k for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert datasets.upload_batches(df.limit(0), "k").count() == 0


def test_prompt_tokens_divide_once(spark):
    df = spark.createDataFrame([(["abc", "abc", "abc"], "name"), ([None], None), (None, None)], "t array<string>, n string")
    assert [r[0] for r in df.select(text.prompt_tokens(F.col("t"))).collect()] == [2, 1, 1]
    assert df.select(text.prompt_tokens(F.col("t"), F.col("n"))).first()[0] == 3


@pytest.mark.parametrize("link", ["../x", "./y", "z?q=1#f", "/r/./s/../t", "//o.net", "?p=2", "https://H.org", "g/..", "../../../up", "a/b/"])
def test_links_resolve_like_urls(spark, link):
    from urllib.parse import urldefrag, urljoin

    base = "https://h.org/a/b/page.html?x=1"
    want = urldefrag(urljoin(base, link))[0].replace("H.org", "h.org")
    want += "/" if want.count("/") == 2 else ""
    df = spark.createDataFrame([(f"<A class=x href='{link}'>t</a><a href=mailto:x@y>m</a><a href=\"#top\">n</a>", base)], "h string, u string")
    assert df.select(text.html_links(F.col("h"), F.col("u"))).first()[0] == ([] if "#" in link else [want])
    assert df.select(text.resolve_link(F.lit(link), F.col("u"))).first()[0] == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [('see {"a":1} or {b}', '{"a":1}'), ('```json\n{"a": {"b": 2}}\n```', '{"a": {"b": 2}}'), ("no object", None), ("{ open", None), ('x {"a": {"b": {}}} y {"c": 1}', '{"a": {"b": {}}}')],
)
def test_first_balanced_object(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(judge.balanced_object(F.col("t"))).first()[0] == want


def test_patterns_of_other_dialects_are_passed_over(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    rule = validators.register_rule(F.col("t"), F.lit("en"), F.lit(True), F.lit(False), patterns=("(?P<x>b)", "(", "b$"))
    assert [r.verdict for r in df.select(F.inline(rule)).collect()] == ["fail"]


def test_sizes_of_joins_are_measured(spark, sf_dir):
    from weftline.session import input_bytes

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").join(docs.select("doc_id"), "doc_id")
    assert input_bytes(joined) <= docs.agg(F.sum(F.octet_length("text"))).first()[0] and input_bytes(docs.where("doc_id > 3")) > 0


def test_repetition_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([10, 29, 30, 60])))) for i in range(80)] + [(80, None), (81, "x " * 40)]
    got = {r.conversation_id: r for r in validators.repetition(spark.createDataFrame(rows, "conversation_id long, text string"), threshold=0.05).collect()}
    for i, x in rows:
        w = (x or "").split()
        grams = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 30 else []
        top = max(grams, key=grams.count) if grams else None
        times = grams.count(top) if grams else 0
        r = got[i]
        assert (r.grams, r.times) == (len(grams), times) and r.gram == (top if grams and times / len(grams) > 0.05 else None)


def plain_layers(nodes, edges, start):
    """By the longest path over a depth-first order; None where the start leads to a cycle."""
    near = {}
    for a, b in edges:
        if a in nodes and b in nodes:
            near.setdefault(a, []).append(b)
    state, order = {}, []
    todo = [(start, 0)]
    while todo:
        x, i = todo.pop()
        state[x] = 1
        if i < len(near.get(x, [])):
            todo.append((x, i + 1))
            y = near[x][i]
            if state.get(y) == 1:
                return None
            if y not in state:
                todo.append((y, 0))
        else:
            state[x] = 2
            order.append(x)
    depth = {start: 0}
    for x in reversed(order):
        for y in near.get(x, []):
            depth[y] = max(depth.get(y, 0), depth[x] + 1)
    behind = max(depth.values()) + 1
    return {x: depth.get(x, behind) for x in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_layers_of_graphs_with_several_paths(spark, seed):
    """Half of them have cycles, of which the start leads to some only."""
    rng = random.Random(seed)
    nodes = list(range(40))
    edges = [(a, b) for a, b in ((rng.randrange(45), rng.randrange(45)) for _ in range(60)) if a < b or (seed % 2 and a > 30)] + [(0, 1), (0, 1)]
    want = plain_layers(nodes, edges, 0)
    frames = spark.createDataFrame([(n,) for n in [*nodes, 3]], "id long"), spark.createDataFrame(edges, "source long, target long")
    if want is None:
        with pytest.raises(ValueError, match="cycle"):
            graphs.layers(*frames, 0)
    else:
        assert {r.id: r.depth for r in graphs.layers(*frames, 0).collect()} == want


def test_layers_of_a_hundred_thousand_nodes(spark):
    """A long cycle is told at once; cycles that the start does not lead to are left aside."""
    nodes = spark.range(100_000)
    down = nodes.where("id >= 1").select(F.floor(F.col("id") / 10).alias("source"), F.col("id").alias("target"))
    apart = spark.range(200_000, 210_000)
    ring = apart.select(F.col("id").alias("source"), F.when(F.col("id") == 209_999, 200_000).otherwise(F.col("id") + 1).alias("target"))
    more = spark.createDataFrame([(200_000, 77)], "source long, target long")
    both, edges = nodes.unionAll(apart), down.unionAll(ring).unionAll(more)
    got = graphs.layers(both, edges, 0).groupBy("depth").count().collect()
    assert {r.depth: r["count"] for r in got} == {0: 1, 1: 9, 2: 90, 3: 900, 4: 9000, 5: 90_000, 6: 10_000}
    with pytest.raises(ValueError, match="cycle"):
        graphs.layers(both, edges.unionAll(spark.createDataFrame([(5, 200_000)], "source long, target long")), 0)


def test_judge_answers_are_parsed_once(spark):
    """The expression stays small: before, each score and the verdict held the whole parsing several times."""
    one = spark.createDataFrame([("x",)], "t string").select(judge.parse_judge(F.col("t"), {"a": 5, "b": 5}).alias("j"))
    assert one._jdf.queryExecution().analyzed().toString().count("parse_json") == 1


def test_conversations_without_a_job_do_not_meet_the_events(spark):
    """No join by job_id has rows of conversations: of a null job_id all would come to one task."""
    make = spark.createDataFrame
    conversations = make([(i, None, None, "x") for i in range(4)], "conversation_id long, persona_id long, run_id long, status string")
    jobs = make([(0, 5), (0, 7), (1, 8), (2, None)], "conversation_id long, job_id long")
    events = make([(7, 2, "b"), (7, 1, "a"), (5, 1, "no")], "job_id long, seq long, kind string")
    none = make([], "conversation_id long, ordinal long, role string, content string")
    checks = make([], "conversation_id long, validator string, verdict string, place int")
    named = lambda key: make([], f"{key} long, name string")
    found = exports.traces(conversations, none, checks, named("persona_id"), named("run_id"), jobs, events)
    traces = {r[0]: json.loads(r[1]) for r in found.collect()}
    assert [(traces[i]["job"], traces[i]["events"]) for i in range(4)] == [({"job_id": 7}, [{"seq": 1, "kind": "a"}, {"seq": 2, "kind": "b"}]), ({"job_id": 8}, []), (None, []), (None, [])]
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [lines[i + 1 :] for i, x in enumerate(lines) if "Join LeftOuter" in x and x.count("job_id")]
    assert below and not any("status#" in "\n".join(x) for x in below[-1:])
