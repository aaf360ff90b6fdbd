"""Graphs: cleaning, bounded search, layout and walks over nodes and edges tables.

Rounds are joins; the tables of a round are cut from their lineage by checkpoint().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import cut, stored


def clean_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First node of each id (id, kind, place), later starts as intents; edges (source, target) with both ends there."""
    first = nodes.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("place"))).where("n = 1").drop("n")
    starts = first.where("kind = 'start'").agg(F.min("place").alias("start_place"))
    first = first.join(F.broadcast(starts)).withColumn("kind", F.when((F.col("kind") == "start") & (F.col("place") > F.col("start_place")), "intent").otherwise(F.col("kind"))).drop("start_place")
    ids = first.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return first, kept.select("source", "target", *[c for c in edges.columns if c not in ("source", "target")])


# What a node of a flow may be.
KINDS = ("start", "intent", "action", "condition", "end")


def _text(path, c="n"):
    return F.when(F.schema_of_variant(F.try_variant_get(c, path, "variant")) == "STRING", F.try_variant_get(c, path, "string"))


def _listed(documents: DataFrame, field: str) -> DataFrame:
    """The entries (graph_id, place, n) of a document's list; what is no object has none. A document is parsed once."""
    return documents.select("graph_id", F.posexplode(F.try_variant_get(F.try_parse_json("document"), f"$.{field}", "array<variant>")).alias("place", "n"))


def _is_object(c):
    """Of an entry with a text in one of its fields this is known; its whole schema, as asked here, is dear."""
    return F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))


def _read(listed: DataFrame) -> DataFrame:
    asked = F.transform(F.coalesce(F.try_variant_get("n", "$.data.toolIds", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$", "string"))
    kind = _text("$.type")
    read = listed.select("graph_id", "place", _text("$.id").alias("id"), kind.alias("kind"), F.when(kind == "action", asked).alias("asked"))
    return read.withColumn("sound", (F.coalesce("id", F.lit("")) != "") & F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))


def _placed(read: DataFrame) -> DataFrame:
    """Sound nodes with their number among those of their id, and of their graph the place of the first start and the count of starts. One shuffle."""
    sound = read.where("sound").drop("sound").repartition("graph_id")
    numbered = sound.withColumn("nth", F.row_number().over(W.partitionBy("graph_id", "id").orderBy("place")))
    start = F.when((F.col("nth") == 1) & (F.col("kind") == "start"), F.col("place"))
    return numbered.withColumns({"first": F.min(start).over(W.partitionBy("graph_id")), "starts": F.count(start).over(W.partitionBy("graph_id"))})


def _kept(placed: DataFrame) -> DataFrame:
    later = (F.col("kind") == "start") & (F.col("place") > F.col("first"))
    return placed.where("nth = 1 AND first IS NOT NULL").withColumn("kind", F.when(later, "intent").otherwise(F.col("kind")))


def _ends(listed: DataFrame) -> DataFrame:
    return listed.select("graph_id", "place", _text("$.id").alias("id"), _text("$.source").alias("source"), _text("$.target").alias("target"), _text("$.label").alias("label"))


def _met(ends: DataFrame, sound: DataFrame) -> DataFrame:
    """The edges of graphs that have a start, and in `met` whether both ends are among the sound nodes. One shuffle by graph, and no join.

    Catalyst takes the entries of a JSON list for few rows; of a join, it would have the ids of all nodes broadcast by the driver.
    """
    ids = sound.select("graph_id", "place", F.col("id").alias("source"), F.col("id").alias("target"), "kind")
    rows = ids.unionByName(ends, allowMissingColumns=True).where("graph_id IS NOT NULL").repartition("graph_id")
    node = F.col("kind").isNotNull()
    rows = rows.withColumn("first", F.min(F.when(node, F.col("place"))).over(W.partitionBy("graph_id", "source")))
    rows = rows.withColumn("opened", F.max((F.col("kind") == "start") & (F.col("place") == F.col("first"))).over(W.partitionBy("graph_id"))).where("opened")
    rows = rows.withColumn("met", F.col("first").isNotNull() & F.max(node).over(W.partitionBy("graph_id", "target")))
    return rows.where(~node).select("graph_id", "place", "id", "source", "target", "label", "met")


def _asked(nodes: DataFrame, tools: DataFrame | None) -> DataFrame:
    """A row for each tool that an action asks for, with its node and whether the tool is known."""
    asked = nodes.where("kind = 'action' AND size(asked) > 0").select("graph_id", "place", "id", "kind", F.posexplode("asked").alias("at", "tool_id"))
    if tools is None:
        return asked.withColumn("known", F.col("tool_id").isNotNull())
    return asked.join(tools.select("tool_id").distinct().withColumn("known", F.lit(True)), "tool_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def coerced_nodes(documents: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """The nodes of `coerced` alone; neither edges nor warnings are computed. Only actions that ask for tools are joined and grouped."""
    nodes = _kept(_placed(_read(_listed(documents, "nodes"))))
    tool = F.struct("at", "tool_id")
    used = _asked(nodes, tools).groupBy("graph_id", "place").agg(F.first("id").alias("id"), F.first("kind").alias("kind"), F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), tool))), lambda x: x["tool_id"]).alias("tools"))
    rest = nodes.where("NOT (kind = 'action' AND size(asked) > 0)").select("graph_id", "place", "id", "kind", F.array().cast("array<string>").alias("tools"))
    return rest.unionAll(used)


def coerced_edges(documents: DataFrame) -> DataFrame:
    """The edges of `coerced` alone."""
    ends = _ends(_listed(documents, "edges")).where("source IS NOT NULL AND target IS NOT NULL")
    edges = _met(ends, _read(_listed(documents, "nodes")).where("sound")).where("met")
    named = edges.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", F.concat(F.lit("e"), (F.col("place") + 1).cast("string"))).otherwise(F.col("id")))
    again = F.row_number().over(W.partitionBy("graph_id", "id").orderBy("place")) > 1
    named = named.withColumn("id", F.when(again, F.concat_ws("_", "id", (F.col("place") + 1).cast("string"))).otherwise(F.col("id")))
    return named.select("graph_id", "place", "id", "source", "target", "label")


def coerced_warnings(documents: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """The warnings of `coerced` alone; sound nodes and edges are stored, as several warnings read them."""
    listed = _listed(documents, "nodes")
    placed, ends = stored(_placed(_read(listed)), "placed"), stored(_ends(_listed(documents, "edges").where(_is_object("n"))), "ends")
    unsound = _read(listed.where(_is_object("n"))).where("NOT sound")
    nodes, starts = _kept(placed), placed.where("nth = 1 AND place = first").select("graph_id", "starts")
    whole = _is_object(F.try_parse_json("document"))
    rows = lambda df, name, subject, n=F.lit(1): df.select("graph_id", F.lit(name).alias("warning"), subject.cast("string").alias("subject"), n.cast("long").alias("n"))
    lost = _asked(nodes, tools).where("NOT known").groupBy("graph_id", "id").agg(F.count("*").alias("lost"))
    dangling = _met(ends, nodes).where("NOT met")
    none = F.lit(None)
    return (
        rows(documents.where(~whole), "not_an_object", none).unionAll(rows(documents.where(whole).join(starts.hint("merge"), "graph_id", "left_anti"), "no_start", none))
        .unionAll(rows(unsound, "invalid_node", F.col("id"))).unionAll(rows(placed.where("nth > 1"), "duplicate_node", F.col("id")))
        .unionAll(rows(lost, "unknown_tools", F.col("id"), F.col("lost"))).unionAll(rows(starts.where("starts > 1"), "several_starts", none, F.col("starts")))
        .unionAll(rows(dangling, "dangling_edge", F.concat(F.coalesce("source", F.lit("")), F.lit("→"), F.coalesce("target", F.lit("")))))
    )


def coerced(documents: DataFrame, tools: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and warnings of flow graphs from their JSON texts (graph_id, document), whatever is in them.

    Nodes (graph_id, place, id, kind, tools): of a JSON object's `nodes`, in order, the objects with a text as id and a kind of `KINDS`; of an id
    the first; starts behind the first become intents; of an action's toolIds those that `tools` (tool_id) has, all without it. Edges
    (graph_id, place, id, source, target, label): those with both ends among the nodes; without an id it is e and the number from 1, and an id
    that an earlier edge has gets its number behind `_`. Warnings (graph_id, warning, subject, n): invalid_node, duplicate_node, unknown_tools,
    several_starts, dangling_edge; errors, of which graphs have no nodes and edges: not_an_object, no_start. Entries that are no objects
    go without a word. No graph is gathered in a row. Who needs one of the three takes `coerced_nodes`, `coerced_edges` or `coerced_warnings`.
    """
    return coerced_nodes(documents, tools), coerced_edges(documents), coerced_warnings(documents, tools)


def reach(edges: DataFrame, roots: DataFrame, max_depth: int = 3, max_nodes: int | None = None) -> DataFrame:
    """Rows (id, depth) of all nodes within `max_depth` steps, each at its first; the feature's cap takes nearest first."""
    seen = roots.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(edges, front["id"] == edges["source"]).select(edges["target"].alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen if max_nodes is None else seen.orderBy("depth", "id").limit(max_nodes)


def _peel(nodes: DataFrame, edges: DataFrame, depth: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Takes away nodes to which no edge is left, round by round: those taken, as (id, depth), those left, as (id), and the rounds.

    `depth` (id, depth) has the nodes that are at a depth of their own accord. A node is as deep as the deepest edge to it says,
    null where no edge comes from a node with a depth. A round reads the edges of the nodes just taken, and for the nodes that
    these meet the edges still waited for; it takes as many rounds as there are layers.
    """
    waits = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    front = cut(nodes.join(waits, "id", "left_anti").join(depth, "id", "left").select("id", "depth"))
    taken, open_, rounds = front, None, 0
    while not front.isEmpty():
        rounds += 1
        met = front.join(edges, front["id"] == edges["source"]).groupBy(edges["target"].alias("id")).agg(F.count("*").alias("seen"), F.max(front["depth"] + 1).alias("depth"))
        if open_ is not None:
            met = met.unionAll(open_).groupBy("id").agg(F.sum("seen").alias("seen"), F.max("depth").alias("depth"))
        met = cut(met.join(waits, "id").select("id", "seen", "depth", (F.col("seen") == F.col("n")).alias("free")))
        own = depth.withColumnRenamed("depth", "own")
        front = cut(met.where("free").join(own, "id", "left").select("id", F.greatest("depth", "own").alias("depth")))
        open_ = met.where("NOT free").select("id", "seen", "depth")
        taken = taken.unionAll(front)
        if rounds % 16 == 0:
            taken = cut(taken)
    taken = cut(taken)
    return taken, cut(nodes.join(taken, "id", "left_anti").select("id")), rounds


def layers(nodes: DataFrame, edges: DataFrame, start: object) -> DataFrame:
    """Rows (id, depth, place): longest path from the start; orphans behind all others. Ids are not null; edges from or to
    ids that are no node do not count, repeated ones and repeated nodes count once.

    By topological peeling, in as many rounds as the graph has layers, with few of the nodes in each. Where the start
    leads to a cycle, its paths have no longest, and a ValueError says so: what peeling from both ends leaves over is
    on cycles or between two, and the start leads there if it is there itself or an edge from a node with a depth is.
    Cycles that the start does not lead to are left aside.
    """
    nodes = nodes.select("id").distinct()
    ends = edges.select("source", "target").distinct()
    ends = cut(ends.join(nodes.withColumnRenamed("id", "source"), "source", "left_semi").join(nodes.withColumnRenamed("id", "target"), "target", "left_semi"))
    first = nodes.where(F.col("id") == F.lit(start)).select("id", F.lit(0).alias("depth"))
    taken, left, _ = _peel(nodes, ends, first)
    if not left.isEmpty():
        inner = ends.join(left.withColumnRenamed("id", "source"), "source", "left_semi").join(left.withColumnRenamed("id", "target"), "target", "left_semi")
        back = inner.select(F.col("source").alias("target"), F.col("target").alias("source"))
        _, core, _ = _peel(left, cut(back), first.where("false"))
        led = taken.where("depth IS NOT NULL").select(F.col("id").alias("source")).join(ends, "source").join(core.withColumnRenamed("id", "target"), "target", "left_semi")
        if not led.isEmpty() or not core.where(F.col("id") == F.lit(start)).isEmpty():
            raise ValueError("the start leads to a cycle: its paths have no longest")
        open_ = cut(ends.join(core.withColumnRenamed("id", "source"), "source", "left_anti").join(core.withColumnRenamed("id", "target"), "target", "left_anti"))
        taken = _peel(nodes.join(core, "id", "left_anti"), open_, first)[0]
    behind = (taken.agg(F.max("depth")).first()[0] or 0) + 1
    placed = nodes.join(taken, "id", "left").select("id", F.coalesce("depth", F.lit(behind)).alias("depth"))
    return placed.withColumn("place", F.row_number().over(W.partitionBy("depth").orderBy("id")) - 1)


def adjacency(edges: DataFrame) -> DataFrame:
    """Rows (source, targets): the targets of each source in the edges' order."""
    return edges.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("targets"))


# Labels of the edges that a condition takes when its attempts are used up.
EXHAUSTED = ("exhausted", "max_retries", "max_attempts", "failed", "escalated", "give_up", "gave_up", "timeout")


def walk(nodes: DataFrame, edges: DataFrame, choices: DataFrame, starts: DataFrame, max_steps: int = 60, max_visits: int = 12) -> DataFrame:
    """Replays many walks at once: rows (walk, step, node, attempt, label, reason), attempt counting the visits of the node.

    `nodes` has id, kind and max_attempts, `edges` source, place, target and label, `choices` walk, step and label, `starts` walk and node.
    At a condition the edge of the chosen label is taken, the first of all where the choice is missing or unknown; beyond
    max_attempts (where it is above 0) the first edge with a label of `EXHAUSTED`, where there is one. Other nodes take
    the first edge. reason says which: first, chosen, unchosen, unknown or exhausted; label is that of the edge taken. A
    walk ends at a node of kind end, without edges or with an edge to no node (reason end), after `max_steps` (steps), and before a
    node's visit after `max_visits`: the row of the step before says guard. Labels of choices are compared as they stand.

    Each walk carries its own visits (at most `max_steps` entries), so no round reads the log; a round is a join with the
    nodes and one with the choices of its step.
    """
    out = edges.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "target", "label"))).alias("out"))
    graph = cut(nodes.select("id", "kind", "max_attempts").join(out, F.col("id") == F.col("source"), "left").drop("source"))
    counts = "map<string,int>"
    now = starts.select("walk", "node", F.map_from_arrays(F.array(F.col("node").cast("string")), F.array(F.lit(1))).cast(counts).alias("visits"))
    log = None
    for step in range(max_steps):
        here = now.join(graph, F.col("node") == F.col("id")).join(choices.where(F.col("step") == step).select("walk", F.col("label").alias("asked"), F.lit(True).alias("any")), "walk", "left")
        condition, first = F.col("kind") == "condition", F.try_element_at("out", F.lit(1))
        named = lambda test: F.try_element_at(F.filter("out", test), F.lit(1))
        spent, chosen = named(lambda e: F.lower(e["label"]).isin(*EXHAUSTED)), named(lambda e: e["label"] == F.col("asked"))
        attempt = F.try_element_at("visits", F.col("node").cast("string"))
        used_up = condition & (F.col("max_attempts") > 0) & (attempt > F.col("max_attempts")) & spent.isNotNull()
        ends = (F.col("kind") == "end") | first.isNull()
        reason = F.when(ends, "end").when(~condition, "first").when(used_up, "exhausted").when(F.col("asked").isNull(), "unchosen").when(chosen.isNull(), "unknown").otherwise("chosen")
        taken = F.when(used_up, spent).when(condition, F.coalesce(chosen, first)).otherwise(first)
        rows = here.select("walk", F.lit(step).alias("step"), "node", attempt.alias("attempt"), reason.alias("reason"), F.when(~ends, taken).alias("edge"), "visits")
        there = rows.join(graph.select(F.col("id").alias("next"), F.lit(True).alias("there")), F.col("edge.target") == F.col("next"), "left")
        visit = F.coalesce(F.try_element_at("visits", F.col("next").cast("string")), F.lit(0)) + 1
        stop = F.when((F.col("reason") == "end") | F.col("there").isNull(), "end").when(visit > max_visits, "guard").when(F.lit(step + 1 == max_steps), "steps").otherwise(F.col("reason"))
        done = cut(there.select("walk", "step", "node", "attempt", F.col("edge.label").alias("label"), stop.alias("reason"), "next", visit.alias("visit"), "visits"))
        part = done.select("walk", "step", "node", "attempt", "label", "reason")
        log = part if log is None else log.unionAll(part)
        if step % 8 == 7:
            log = cut(log)
        on = done.where("reason NOT IN ('end', 'guard', 'steps')")
        if on.isEmpty():
            break
        key = F.col("next").cast("string")
        others = F.map_filter("visits", lambda k, v: k != key)
        now = on.select("walk", F.col("next").alias("node"), F.map_concat(others, F.map_from_arrays(F.array(key), F.array("visit"))).alias("visits"))
    return log
