r"""Chat formatting from event logs.

A log has one row per event: conv_id, seq, message (the ordinal of the message it applies to), kind, role, text.
`message` states a whole message, `delta` appends streamed text, `edit` replaces the text, `regenerate` discards the
text and everything logged before it for later messages of the conversation. `fold` partitions logs by conversation,
sorts by sequence and reduces them to final messages; `render` writes each with the template

    <|im_start|>role\n text <|im_end|>\n

with a loss mask over assistant texts. Control strings inside texts and roles cannot end a turn: `<`, any number of
backslashes, `|` gets one more backslash, which `unescape` takes away again; in roles, line feeds are `\n`, too.

One shuffle, on conv_id, serves all steps. Messages are rendered one by one; nothing holds a whole conversation but
`assemble`, which is asked to. `digest` streams over each conversation in order, in constant memory.

Defined results: null texts and roles are empty; a null conv_id is a conversation; events of equal sequence go by kind
(message, edit, regenerate, then delta) and text; deltas without any message before them start one; a null kind is a
message. Nulls sort first. An empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import ship

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "edit", "regenerate", "delta")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A log of whole messages from a table with one row per turn; repeated turns are messages of their own."""
    order = W.partitionBy(conv).orderBy(turn, "role", "text")
    columns = [F.col(conv).alias("conv_id"), F.col(turn).alias("seq"), F.row_number().over(order).cast("long").alias("message")]
    return rows.select(*columns, F.lit("message").alias("kind"), "role", "text")


def as_log(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A log, as a chat service would have written it, that folds to a table with one row per turn.

    By a hash of the turn, its text comes whole, streamed in three deltas, as an edit of another text, or after a
    regeneration that discards another text and a message logged behind it. The same turns give the same log.
    """
    kind, text, role = F.pmod(F.xxhash64("conv_id", "message", "text"), F.lit(4)), F.coalesce("text", F.lit("")), F.col("role")
    third = F.ceil(F.length(text) / 3).cast("int")
    other = F.concat(F.reverse(text), F.lit("?"))

    def event(step, kind, role, text, message=F.col("message")):
        return F.struct((F.col("message") * 8 + step).alias("seq"), message.alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    def streamed(step):
        return [event(step + i, "delta", F.lit(None).cast("string"), F.substr(text, third * i + 1, third if i < 2 else F.length(text))) for i in range(3)]

    nobody, nothing = F.lit(None).cast("string"), F.lit("")
    log = (
        F.when(kind == 0, F.array(event(0, "message", role, text)))
        .when(kind == 1, F.array(event(0, "message", role, nothing), *streamed(1)))
        .when(kind == 2, F.array(event(0, "message", role, other), event(1, "edit", nobody, text)))
        .otherwise(F.array(event(0, "message", role, other), event(1, "message", role, other, F.col("message") + 1), event(2, "regenerate", nobody, nothing), *streamed(3)))
    )
    return as_events(rows, conv, turn).select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """Rows (conv_id, message, role, text) of the final messages."""
    kind = F.coalesce("kind", F.lit("message"))
    events = events.select("conv_id", "message", "seq", kind.alias("kind"), F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("rank"), "role", F.coalesce("text", F.lit("")).alias("text"))
    earlier = W.partitionBy("conv_id").orderBy("message").rangeBetween(W.unboundedPreceding, -1)
    redone = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    events = events.withColumn("redone", redone).where("redone IS NULL OR seq > redone")
    own = W.partitionBy("conv_id", "message")
    events = events.withColumn("place", F.row_number().over(own.orderBy("seq", "rank", "text")))
    begun = F.coalesce(F.max(F.when(F.col("kind") != "delta", F.col("place"))).over(own), F.lit(0))
    named = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("place"))).over(own)
    events = events.withColumns({"begun": begun, "role": F.coalesce(named, F.lit(""))}).where("place >= begun")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "")
    return events.groupBy("conv_id", "message").agg(F.first("role").alias("role"), text.alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Rows (conv_id, message, piece, loss_start, loss_chars); a conversation's pieces joined in order are its output.

    loss_start counts code points from the piece's beginning; loss_chars is 0 where nothing is trained on.
    """
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    loss = F.when(F.col("role") == trained, F.length(text)).otherwise(0)
    return messages.select("conv_id", "message", F.concat(head, text, F.lit(END + "\n")).alias("piece"), F.length(head).alias("loss_start"), loss.alias("loss_chars"))


def assemble(pieces: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, loss_spans): whole conversations, each in one row, with spans as (start, end)."""
    before = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.col("loss_start")
    placed = pieces.withColumn("span", F.when(F.col("loss_chars") > 0, F.struct(start.alias("start"), (start + F.col("loss_chars")).alias("end"))))
    ordered = F.array_sort(F.collect_list(F.struct("message", "piece", "span")))
    rows = placed.groupBy("conv_id").agg(ordered.alias("p"))
    return rows.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("p", lambda x: x["span"]), F.isnotnull).alias("loss_spans"))


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.DOTALL)


def digest(pieces: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output.

    conv_id keeps its type; null is a conversation, too.
    """
    ship(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, state = none, None

        def row():
            n, turns, chars, loss, size = state
            return {"conv_id": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for batch in batches:
            done = []
            for conv, _, piece, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is none or conv != now:
                    if now is not none:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = _TURN.fullmatch(piece).groups()
                state[0] += 1
                state[1].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                trained = unescape(piece[start : start + length])
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(piece)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=wire(batch))
        if now is not none:
            yield pa.RecordBatch.from_pylist([row()], schema=wire(batch))

    kinds = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}
    wire = lambda batch: pa.schema([("conv_id", batch.schema.field(0).type), *[(k, pa.string() if v == "string" else pa.int64()) for k, v in kinds.items()]])
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.mapInArrow(run, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))
