r"""The prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of the first d turns; its members are the conversations that begin with it. A node's key
is its depth and the exclusive or of two 64-bit hashes of each (place, role, text) of its sequence, so a parent's key
is the child's without its own last turn, and no key needs the rows before it: keys are running totals.

Sums over subtrees: the largest child of a node (most members; of equals the one with the smallest conversation)
continues the node's path, every other child begins a path of its own. Sums run from the bottom of each path to its
top; paths hang on their parents by light edges, of which a walk to the root meets at most log2(conversations), since
a light child has at most half its parent's members. So the totals of the paths are made level by level from the
deepest, in as many rounds as there are levels; each attaches to the node above its top and enters that path's total.

Conversations, paths and the members that end at one node may each be larger than any task. All three are summed over
ranges of one order (`in_order`): a range's own running sums, and what comes from earlier ranges (`carried`, one row a
range at most). Texts never leave the scan; only their hashes and lengths do.

Defined results: null turns come first; rows of one turn go by the MD5 of role, line feed and text; a null role or text is
empty. Rows with a null conv_id are no conversation and left out. Repeated rows are turns of their own. Columns other
than conv_id, turn, role and text are left alone. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.ranges import carried, in_order, tie
from weftline.llm.staging import stage
from weftline.session import ship

#: A rebuilt conversation takes fewer turns than this from the first of each `GROUP`.
SHARED, GROUP = 9, 5
KEY = ["depth", "ka", "kb"]
#: Ids of one node whose decimal forms are put together before they are hashed.
BLOCK_IDS = 4096


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, said, bytes): each turn's place from 1, a hash of role and text, and the text's length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("__turn"), F.md5(F.concat(role, F.lit("\n"), text)).alias("__key"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("said"), F.octet_length(text).cast("long").alias("bytes"), tie().alias("__tie"),
    )
    placed = in_order(slim, [F.col("conv_id"), F.col("__turn").asc_nulls_first(), F.col("__key"), F.col("__tie")], "turns")
    return numbered(placed, "pos").drop("chunk", "place")


def _with_carried(placed: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """`before` has a row a chunk at most, so every task can have it."""
    return placed.join(F.broadcast(before), [*key, "chunk"], "left")


def numbered(placed: DataFrame, name: str) -> DataFrame:
    """`placed` with the number of each row in its conversation, from 1."""
    own = F.row_number().over(W.partitionBy("conv_id", "chunk").orderBy("place"))
    before = carried(placed, ["conv_id"], before=(F.count("*"), F.sum))
    return _with_carried(placed.withColumn(name, own), before, ["conv_id"]).withColumn(name, F.col(name) + F.coalesce("before", F.lit(0))).drop("before")


def rebuilt(turns: DataFrame) -> DataFrame:
    """`turns` of conversations c of which the first h come from conversation c - c % GROUP; h is a hash of c, below SHARED."""
    h = F.crc32(F.col("conv_id").cast("string")) % SHARED
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("__part"), F.col("pos").alias("__pos"), "said", "bytes")
    firsts = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("base"), F.col("pos").alias("__pos"), "said", "bytes")
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), h.alias("h"))
    taken = ids.where("h > 0").join(firsts, "base").where("__pos <= h").select("conv_id", F.lit(0).alias("__part"), "__pos", "said", "bytes")
    return own.unionAll(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, ka, kb, pa, pb, bytes, chunk): of each conversation in `turns` (conv_id, __part, __pos, said, bytes) the key of
    every prefix and of the prefix before."""
    placed = in_order(turns, [F.col("conv_id"), F.col("__part"), F.col("__pos")], "rebuilt")
    rows = numbered(placed, "depth").withColumns({"a": F.xxhash64("said", "depth"), "b": F.xxhash64("depth", "said")})
    running = W.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    before = carried(rows, ["conv_id"], xa=(F.bit_xor("a"), F.bit_xor), xb=(F.bit_xor("b"), F.bit_xor))
    rows = _with_carried(rows.withColumns({"ka": F.bit_xor("a").over(running), "kb": F.bit_xor("b").over(running)}), before, ["conv_id"])
    whole = lambda own, was: F.col(own).bitwiseXOR(F.coalesce(was, F.lit(0).cast("long")))
    rows = rows.withColumns({"ka": whole("ka", "xa"), "kb": whole("kb", "xb")})
    parents = [F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb")]
    return stage(rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "ka", "kb", *parents, "bytes", "chunk"), "prefixes")


def _family(nodes: DataFrame) -> DataFrame:
    """`nodes` with n_children, and whether each is its parent's largest child."""
    rank = F.struct("n_convs", F.bitwise_not("conv_id").alias("c"), "ka", "kb")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"), F.max(rank).alias("heir"))
    kids = stage(kids, "kids")
    heirs = kids.select((F.col("depth") + 1).alias("depth"), F.col("heir.ka").alias("ka"), F.col("heir.kb").alias("kb"), F.lit(True).alias("heavy"))
    both = nodes.join(kids.drop("heir"), KEY, "left").join(heirs, KEY, "left")
    return stage(both.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "heavy": F.coalesce("heavy", F.lit(False))}), "nodes")


def _on_paths(rows: DataFrame, nodes: DataFrame, root: int) -> DataFrame:
    """`nodes` below the root with parent_conv_id, the top of the path each is on, the top of the path above that one, and the number of light edges above.

    A conversation's rows meet their nodes' flags; running maxima along it give the last node that began a path.
    """
    flags = nodes.where("depth > 0").select(*KEY, F.col("conv_id").alias("owner"), "heavy")
    met = rows.select("conv_id", "chunk", *KEY).join(flags, KEY)
    top = F.when(~F.col("heavy"), F.struct(*KEY))
    own = W.partitionBy("conv_id", "chunk").orderBy("depth")
    earlier = own.rowsBetween(W.unboundedPreceding, -1)
    lights = F.sum(F.when(F.col("heavy"), 0).otherwise(1))
    last = F.max(F.struct("depth", "owner"))
    before = carried(met, ["conv_id"], top_before=(F.max(top), F.max), last_before=(last, F.max), lights_before=(lights, F.sum))
    met = met.withColumns({"above": F.max(top).over(earlier), "last": last.over(earlier), "lights": lights.over(own.rowsBetween(W.unboundedPreceding, 0))})
    met = _with_carried(met, before, ["conv_id"]).where("conv_id = owner")
    first = F.struct(*[F.lit(0).cast("long").alias(c) for c in KEY])
    above = F.coalesce("above", "top_before", first)
    found = met.select(
        *KEY, F.coalesce("last.owner", "last_before.owner", F.lit(root)).alias("parent_conv_id"), above.alias("above"),
        F.when(F.col("heavy"), above).otherwise(F.struct(*KEY)).alias("top"), (F.col("lights") + F.coalesce("lights_before", F.lit(0))).alias("level"),
    )
    return nodes.where("depth > 0").join(found, KEY)


def _attached(nodes: DataFrame) -> DataFrame:
    """Rows (KEY, leaves_below, saved_below): what the paths that hang on each node hold, by rounds over the light levels."""
    light = ~F.col("heavy")
    paths = nodes.groupBy("top", "level").agg(
        F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(light, F.col("above"))).alias("above"),
        F.max(F.when(light, F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")))).alias("on"),
    )
    paths = stage(paths, "paths")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done, inner = [], None
    for level in range(deepest, 0, -1):
        now = paths.where(F.col("level") == level)
        if inner is not None:
            now = now.join(inner, "top", "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_in", F.lit(0)) for c in ("leaves", "saved")})
        now = stage(now.select("above", "on", "leaves", "saved"), "level")
        inner = now.groupBy(F.col("above").alias("top")).agg(F.sum("leaves").alias("leaves_in"), F.sum("saved").alias("saved_in"))
        done.append(now)
    if not done:
        return nodes.sparkSession.createDataFrame([], "depth long, ka long, kb long, leaves_below long, saved_below long")
    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    return every.groupBy("on").agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below")).select("on.*", "leaves_below", "saved_below")


def with_sums(nodes: DataFrame) -> DataFrame:
    """`nodes` (KEY, pa, pb, heavy, top, above, level, leaf, saved) with n_leaves and saved_tokens of their subtrees."""
    full = nodes.join(_attached(nodes), KEY, "left")
    full = full.withColumns({"leaf": F.col("leaf") + F.coalesce("leaves_below", F.lit(0)), "saved": F.col("saved") + F.coalesce("saved_below", F.lit(0)), "td": F.col("top.depth"), "ta": F.col("top.ka"), "tb": F.col("top.kb")})
    path = ["td", "ta", "tb"]
    placed = in_order(full.drop("top", "above", "leaves_below", "saved_below"), [*map(F.col, path), F.desc("depth")], "sums")
    before = carried(placed, path, leaves=(F.sum("leaf"), F.sum), tokens=(F.sum("saved"), F.sum))
    running = W.partitionBy(*path, "chunk").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumns({"n_leaves": F.sum("leaf").over(running), "saved_tokens": F.sum("saved").over(running)})
    whole = {n: F.col(n) + F.coalesce(b, F.lit(0)) for n, b in (("n_leaves", "leaves"), ("saved_tokens", "tokens"))}
    return _with_carried(placed, before, path).withColumns(whole).drop("leaves", "tokens", *path)


def ends(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (KEY, ends_sha256) of the nodes at which conversations end; conversations without turns end at the root."""
    ship(rows.sparkSession)
    bare = ids.select("conv_id", F.struct(*[F.lit(0).cast("long").alias(c) for c in KEY]).alias("end"))
    last = bare.unionAll(rows.select("conv_id", F.struct(*KEY).alias("end"))).groupBy("conv_id").agg(F.max("end").alias("end"))
    placed = in_order(last.select("end.*", "conv_id"), [*map(F.col, KEY), F.col("conv_id")], "ends")
    block = F.floor((F.row_number().over(W.partitionBy(*KEY, "chunk").orderBy("place")) - 1) / BLOCK_IDS)
    blocks = placed.withColumn("block", block).groupBy(*KEY, "chunk", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk", "block").select(*KEY, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for *key, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(listed.encode())
                else:
                    sha.update(b"," + listed.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], [*KEY, "ends_sha256"])

    return ordered.mapInArrow(run, "depth long, ka long, kb long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one a node.

    `turns` (conv_id, __part, __pos, said, bytes) in the order of part and place; `ids` (conv_id) has every conversation, those without turns too.
    """
    ids = ids.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = prefixes(turns)
    root, members = ids.agg(F.min("conv_id"), F.count("*")).first()
    zero = F.lit(0).cast("long")
    top = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = top.where("n_convs > 0").select(*[zero.alias(c) for c in KEY], "conv_id", "n_convs", *[zero.alias(c) for c in ("bytes", "pa", "pb")])
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("bytes", "pa", "pb")])
    nodes = _family(nodes.unionAll(top))
    first = F.struct(*[zero.alias(c) for c in KEY])
    begin = nodes.where("depth = 0").select("*", F.lit(None).cast("long").alias("parent_conv_id"), first.alias("above"), first.alias("top"), zero.alias("level"))
    placed = _on_paths(rows, nodes, root or 0).select(begin.columns).unionAll(begin)
    placed = placed.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    summed = with_sums(stage(placed, "placed"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    done = summed.join(ends(rows, ids), KEY, "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def as_turns(turns: DataFrame) -> DataFrame:
    """Turns as they are, for `trie`."""
    return turns.select("conv_id", F.lit(0).alias("__part"), F.col("pos").alias("__pos"), "said", "bytes")
