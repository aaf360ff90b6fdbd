r"""Repair of the structure of conversations by weighted finite-state composition.

Three machines are composed: an acceptor of the conversation's rows; a transducer of edits, K keeps a row (cost 0), R
gives it the role user or assistant (1), D deletes it (2), I inserts a user or assistant row with an empty text (5);
and an acceptor of the grammar of role initials, `(s?(ua)+)?`. Blank and duplicate rows must be deleted, truncated ones
cost 5 more if they stay. The arcs of the composed machine are made when a row first needs them, and kept. Weights are
pairs (cost, string of edits) under the lexicographic minimum. The machine's states are (rows read, grammar state), a
topological order is that of the rows, and the arcs that leave one state have different edits; so the least string
among the cheapest paths is found by costs to the end, and by the lesser edit wherever costs tie.

A conversation may be larger than any task. Rows, without their texts, are dealt out by ranges of the order
(`in_order`). Conversations inside a range are solved there. The parts of others become 4 by 4 matrices of costs in the
min-plus semiring, at most two a range; these are folded backward to the costs after each part, with which each part
finds its edits for each state it may begin in, and forward to the states where the parts do begin. Texts are
shuffled once, for the digest, which streams over each conversation in constant memory but for its string of edits.

Faults of a row, the first that applies: blank (no character but blanks), duplicate (role and text are those of an
earlier row), truncated (the last character that is no blank is none of `.!?`).

Defined results: null roles and texts are one space; a null conv_id is a conversation; null turns come first. Rows of
one turn go by the MD5 of role, line feed and text as they were before any damage. A role counts by its first
character, an empty one has none and can only be given another role or be deleted. A conversation of which no row is left has
zeros, an empty audit and the hash of the empty string. Other columns are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.ranges import in_order, tie
from weftline.llm.staging import stage
from weftline.session import ship

BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: The grammar's states and, by state, the initials that may follow and where they lead.
START, SYSTEM, USER, REPLY = range(4)
GRAMMAR = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": REPLY}, {"u": USER})
FINAL = (START, REPLY)
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60


def edits(initial: str, fault: str, state: int) -> list[tuple[int, str, int]]:
    """The composed arcs that read a row in a grammar state: (cost, edit, next state)."""
    arcs = [(DELETE, "D", state)]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        arcs += [(more, "K", to) for out, to in GRAMMAR[state].items() if out == initial]
        arcs += [(RELABEL + more, "R", to) for out, to in GRAMMAR[state].items() if out in ROLES]
    return arcs


def insertions(state: int) -> list[tuple[int, str, int]]:
    return [(INSERT, "I", to) for out, to in GRAMMAR[state].items() if out in ROLES]


def _with_insertions(costs: list[int]) -> tuple[int, ...]:
    for _ in GRAMMAR:
        costs = [min([c, *(w + costs[to] for w, _, to in insertions(q))]) for q, c in enumerate(costs)]
    return tuple(min(c, NEVER) for c in costs)


#: Costs to the end where no row is left.
END = _with_insertions([0 if q in FINAL else NEVER for q in range(4)])


def _level(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs less their minimum, and it: differences of costs are few, so that steps can be kept."""
    low = min(costs)
    return tuple(c if c >= NEVER else c - low for c in costs), low


@lru_cache(maxsize=1 << 16)
def step(initial: str, fault: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple]:
    """From the costs after a row: levelled costs before it, the level, and by state the edits that read it.

    The last are (edits, next state, cost), insertions before the row included.
    """
    reads = [[(w + after[to], label, to, w) for w, label, to in edits(initial, fault, q)] for q in range(4)]
    before = _with_insertions([min(r)[0] for r in reads])
    taken = []
    for q in range(4):
        path, cost, at = "", 0, q
        while before[q] < NEVER:
            stay = [(w + before[to], label, to, w) for w, label, to in insertions(at)]
            _, label, to, w = min(reads[at] + stay)
            path, cost, at = path + label, cost + w, to
            if label != "I":
                break
        taken.append((path, at, cost))
    level, low = _level(before)
    return level, low, tuple(taken)


def matrix(rows: list[tuple[str, str]]) -> list[int]:
    """The least cost from each state before the rows to each state after them, row by row of the matrix."""
    columns = []
    for q in range(4):
        costs, total = tuple(0 if p == q else NEVER for p in range(4)), 0
        for initial, fault in reversed(rows):
            costs, low, _ = step(initial, fault, costs)
            total += low
        columns.append([min(NEVER, c + total) for c in costs])
    return [columns[q][p] for p in range(4) for q in range(4)]


def solve(rows: list[tuple[str, str]], after: tuple[int, ...], entries: tuple[int, ...], last: bool) -> list[tuple[int, int, str]]:
    """By state of entry: the state after the rows, the cost and the edits of the best path; `last`: nothing follows."""
    now, steps = _level(after)[0], []
    for initial, fault in reversed(rows):
        now, _, taken = step(initial, fault, now)
        steps.append(taken)
    found = []
    for state in entries:
        path, total = [], 0
        for taken in reversed(steps):
            label, state, cost = taken[state]
            path.append(label)
            total += cost
        while last and state not in FINAL:
            cost, label, state = insertions(state)[0]
            path.append(label)
            total += cost
        found.append((state, total, "".join(path)))
    return found


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, __tie, __copy) with the faults that a hash of id and turn chooses; __key orders a turn's rows."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"), tie().alias("__tie"))
    rows = rows.where("kind <> 0").withColumn("__key", F.md5(F.concat("role", F.lit("\n"), "text")))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "__key", "__tie", copies.alias("__copy"))


ORDER = ("conv_id", "turn", "__key", "__tie", "__copy")


def find_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, initial, fault, chunk, place), in order, without texts; fault is b, d, t or a dot."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    own = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), ".").otherwise("t")
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), own.alias("own"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("said"), "__key", "__tie", "__copy")
    placed = in_order(slim, [F.col(c).asc_nulls_first() for c in ORDER], "turns")
    firsts = placed.groupBy("conv_id", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when((F.col("own") != "b") & F.col("first").isNull(), "d").otherwise(F.col("own"))
    return stage(placed.join(firsts, "place", "left").select("conv_id", "turn", "initial", fault.alias("fault"), "chunk", "place"), "faults")


def _parts(faults: DataFrame, work, fields: list[str], schema: str) -> DataFrame:
    """`work(conv, chunk, rows, open, extra)` gives the row of each conversation's part in a chunk; open: it may go on in another."""
    ship(faults.sparkSession)
    conv = faults.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, head, wire = None, [], True, None
        found: list[tuple] = []

        def batch():
            names = ["conv_id", "chunk", *fields]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(wire)], names)

        def close(is_open):
            found.append(work(now[0], now[1], rows, is_open, extra))

        extra = None
        for b in batches:
            if wire is None:
                wire = [b.schema.field("conv_id").type, pa.int32(), *_WIRE[schema]]
            columns = [c.to_pylist() for c in b.columns]
            for conv_id, chunk, turn, initial, fault, more in zip(*columns, strict=True):
                if now is None or (conv_id, chunk) != now:
                    if now is not None:
                        close(head or chunk != now[1])
                    head = now is None or chunk != now[1]
                    now, rows = (conv_id, chunk), []
                rows.append((turn, initial, fault))
                extra = more
            if found:
                yield batch()
                found.clear()
        if now is not None:
            close(True)
            yield batch()

    ordered = faults.repartition("chunk").sortWithinPartitions("place")
    return ordered.select("conv_id", "chunk", "turn", "initial", "fault", "extra").mapInArrow(run, f"conv_id {conv}, chunk int, {schema}")


_COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, initial string, final string"
_FIRST = f"{_COUNTS}, open boolean, costs array<bigint>, cost long, audit string"
_AGAIN = "exits array<int>, totals array<bigint>, audits array<string>"
_LONGS = pa.list_(pa.int64())
_WIRE = {
    _FIRST: [*[pa.int64()] * 8, pa.string(), pa.string(), pa.bool_(), _LONGS, pa.int64(), pa.string()],
    _AGAIN: [pa.list_(pa.int32()), _LONGS, pa.list_(pa.string())],
}


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(", ")]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _first(conv, chunk, rows, is_open, _):
    turns = [t for t, _, _ in rows if t is not None]
    faults = [f for _, _, f in rows]
    illegal = sum(not _legal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False))
    counts = (len(rows), faults.count("b"), faults.count("d"), faults.count("t"), illegal, len(set(turns)), min(turns, default=None), max(turns, default=None), rows[0][1], rows[-1][1])
    said = [(i, f) for _, i, f in rows]
    if is_open:
        return conv, chunk, *counts, True, matrix(said), None, None
    ((_, cost, audit),) = solve(said, END, (START,), True)
    return conv, chunk, *counts, False, None, cost, audit


def _again(conv, chunk, rows, _, extra):
    found = solve([(i, f) for _, i, f in rows], tuple(extra[:4]), tuple(range(4)), bool(extra[4]))
    return conv, chunk, [s for s, _, _ in found], [c for _, c, _ in found], [a for _, _, a in found]


def _after(parts: DataFrame) -> DataFrame:
    """Rows (conv_id, chunk, extra) of the open parts: costs after each, and 1 if it is its conversation's last."""

    def fold(part):
        part = part.sort_values("chunk")
        now, last, out = list(END), 1, []
        for costs in part["costs"][::-1]:
            out.append([*now, last])
            now, last = [min(NEVER, *(int(costs[4 * p + q]) + now[q] for q in range(4))) for p in range(4)], 0
        return part[["conv_id", "chunk"]].assign(extra=out[::-1])

    conv = parts.schema["conv_id"].dataType.simpleString()
    return parts.select("conv_id", "chunk", "costs").groupBy("conv_id").applyInPandas(fold, f"conv_id {conv}, chunk int, extra array<bigint>")


def _entries(parts: DataFrame) -> DataFrame:
    """Rows (conv_id, chunk, entry) of the open parts: the state in which each begins."""

    def fold(part):
        part = part.sort_values("chunk")
        state, out = START, []
        for exits in part["exits"]:
            out.append(state)
            state = int(exits[state])
        return part[["conv_id", "chunk"]].assign(entry=out)

    conv = parts.schema["conv_id"].dataType.simpleString()
    return parts.select("conv_id", "chunk", "exits").groupBy("conv_id").applyInPandas(fold, f"conv_id {conv}, chunk int, entry int")


def audits(faults: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every id of `ids` (conv_id)."""
    parts = stage(_parts(faults.withColumn("extra", F.lit(None).cast("array<bigint>")), _first, _names(_FIRST), _FIRST), "parts")
    same = lambda a, b: F.expr(f"{a}.conv_id <=> {b}.conv_id AND {a}.chunk = {b}.chunk")
    # At most two parts of each chunk are open, so these tables have two rows a task of the sort.
    after = F.broadcast(_after(parts.where("open"))).alias("a")
    rest = faults.alias("f").join(after, same("f", "a")).select("f.*", "a.extra")
    again = stage(_parts(rest, _again, _names(_AGAIN), _AGAIN), "open")
    begun = F.broadcast(_entries(again)).alias("e")
    at = F.col("entry") + 1
    solved = again.alias("o").join(begun, same("o", "e")).select("o.conv_id", "o.chunk", F.element_at("totals", at).alias("cost"), F.element_at("audits", at).alias("audit"))
    counts = [c for c in parts.columns if c not in ("open", "costs", "cost", "audit")]
    closed = parts.where("NOT open").select(*counts, "cost", "audit")
    opened = parts.where("open").alias("p").join(F.broadcast(solved).alias("s"), same("p", "s")).select(*[f"p.{c}" for c in counts], "s.cost", "s.audit")
    none = ids.select("conv_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in closed.schema.fields if f.name != "conv_id"])
    order = W.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first())
    whole = closed.unionAll(opened).unionAll(none.select(closed.columns))
    met = F.lag("final").over(order)
    whole = whole.withColumns({
        "join": F.when(met.isNotNull() & F.col("initial").isNotNull() & ~F.concat(met, F.col("initial")).isin("su", "ua", "au"), 1).otherwise(0),
        "shared": F.when(F.lag("high").over(order) == F.col("low"), 1).otherwise(0),
    })
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.sum("shared")), F.lit(0)).cast("long")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("chunk", "audit")))), lambda x: x["audit"]), "")
    return whole.groupBy("conv_id").agg(
        gaps.alias("gaps"), *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (total("illegal") + total("join")).alias("illegal"), total("cost").alias("cost"), audit.alias("audit"),
    )


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of the repaired conversation, from its edits and its rows."""
    state = START
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        initial = role[0] if edit == "K" else next(i for i in GRAMMAR[state] if i in ROLES)
        state = GRAMMAR[state][initial]
        yield f"{role if edit == 'K' else ROLES[initial]}:{text}"


def digest(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """`summary` with repaired_sha256; it streams over the rows of each conversation in order."""
    ship(summary.sparkSession)
    fields = [f for f in summary.schema.fields if f.name != "conv_id"]
    head = summary.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast(t).alias(n) for n, t in (("__key", "string"), ("__copy", "int"), ("role", "string"), ("text", "string"))], F.struct(*[f.name for f in fields]).alias("summary"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "__key", "__copy", "role", "text", F.lit(None).cast(head.schema["summary"].dataType).alias("summary"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "__key", "__copy")]
    both = head.unionAll(body).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "summary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wire = None
        done: list[dict] = []

        def rows():
            nonlocal wire
            for b in batches:
                wire = [b.schema.field("conv_id"), *b.schema.field("summary").type]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        stream = rows()
        head = next(stream, None)
        while head is not None:
            conv, _, _, summary = head
            head = None

            def own():
                nonlocal head
                for row in stream:
                    if row[3] is not None:
                        head = row
                        return
                    yield row[1], row[2]

            said, sha, first = own(), hashlib.sha256(), True
            for line in repaired_lines(summary["audit"], said):
                sha.update(line.encode() if first else f"\n{line}".encode())
                first = False
            if next(said, None) is not None:
                raise ValueError(f"conversation {conv}: the edits do not read all rows")
            done.append({"conv_id": conv, **summary, "repaired_sha256": sha.hexdigest()})
            if len(done) >= 256 or head is None:
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema([*wire, ("repaired_sha256", pa.string())]))
                done.clear()

    conv = summary.schema["conv_id"].dataType.simpleString()
    listed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return both.mapInArrow(run, f"conv_id {conv}, {listed}, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the conversations in
    `rows`, as `damage` or `as_is` gives them, and of those in `ids` that have no rows."""
    ids = rows.select("conv_id") if ids is None else ids.select("conv_id")
    return digest(audits(find_faults(rows), ids.distinct()), rows)


def as_is(rows: DataFrame) -> DataFrame:
    """Rows as `damage` gives them, with no damage done."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"))
    return slim.select("*", F.md5(F.concat("role", F.lit("\n"), "text")).alias("__key"), tie().alias("__tie"), F.lit(1).alias("__copy"))
