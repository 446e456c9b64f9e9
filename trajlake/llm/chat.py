"""Chat formatting from a log of events: reconstructed conversations, rendered with a template that can be read back.

The log has a row for each event (conv_id, seq, kind, message, role, text). In the order of seq, a `start` begins a message, a
`delta` adds to its text, an `edit` puts another text in its place, a `regenerate` begins it anew and takes back all
messages that began after it and before the event, a `delete` takes it out. Logs are dealt by conversation and message and
sorted within; what regenerations take back is found by windows over pieces of a conversation, and formatted conversations are
made in parts of PART steps of seq, so that no conversation has to fit into one task.

A turn is `<turn ROLE>`, a line end, the text, `</turn>`, a line end. In texts a backslash stands before `<turn `, `</turn>`
and backslashes, in roles before backslashes, `>` and line ends; it goes when the text is read back. Spans mark where
the loss is taken: the texts of assistants, without template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import pieces
from ._scratch import map_batches

#: Kinds of events in the order in which those of one seq apply.
KINDS = ("start", "regenerate", "edit", "delta", "delete")
#: Steps of seq in one part of a formatted conversation, and code points that a turn's text has at most while it is hashed.
PART = 4096
TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*+)>\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escaped(text: str) -> str:
    return re.sub(r"\\|<turn |</turn>", r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns (role, text), and the spans (start, stop, in code points) of the texts of the trained role."""
    out, spans, at = [], [], 0
    for role, text in turns:
        name, body = re.sub(r"[\\>\n]", r"\\\g<0>", role), escaped(text)
        start = at + len(name) + 8
        if role == trained:
            spans.append((start, start + len(body)))
        out.append(f"<turn {name}>\n{body}</turn>\n")
        at = start + len(body) + 8
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of what render() made; a ValueError for anything else."""
    turns, at = [], 0
    while at < len(formatted):
        if not (found := TURN.match(formatted, at)):
            raise ValueError(f"no turn at code point {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


def messages(events: DataFrame) -> DataFrame:
    """conv_id, at (the seq that a message began with), message, role and text of the messages that are there in the end.

    Events of one seq apply in the order of KINDS, then by text. A message without a start begins with its first event; its
    role is the last one given, else empty. Null texts are empty; null conversations and messages are ones like others; an event of
    another kind, or with a null seq, is left out. Repeated events apply each. Other columns play no part.
    """
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    known = events.filter((kind > 0) & F.col("seq").isNotNull())
    event = F.struct(F.col("seq").cast("long").alias("seq"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role"))
    listed = known.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("events"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq").cast("long"))).alias("again"))
    backward, delta = F.reverse("events"), KINDS.index("delta") + 1
    since = F.array_position(F.transform(backward, lambda e: e["kind"] != delta), True)  # to the last event that isn't a delta
    tail = F.reverse(F.slice(backward, F.lit(1), F.when(since > 0, since).otherwise(F.size("events")).cast("int")))
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    told = listed.select(
        "conv_id", "message", F.get("events", F.lit(0))["seq"].alias("at"), "again", F.coalesce(F.get(F.reverse(roles), F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(tail, lambda e: e["text"]), "").alias("text"), (F.get(tail, F.lit(0))["kind"] == KINDS.index("delete") + 1).alias("gone"),
    )
    return without_taken_back(told).filter("NOT gone").select("conv_id", "at", "message", "role", "text")


def without_taken_back(told: DataFrame) -> DataFrame:
    """Without the messages that begin (`at`) between the beginning of another one and its last regeneration (`again`)."""
    marks = F.explode(F.array_compact(F.array(F.struct(F.col("at").alias("point"), F.lit(None).cast("long").alias("begun")), F.when(F.col("again") > F.col("at"), F.struct(F.col("again").alias("point"), F.col("at").alias("begun"))))))
    points = told.select("conv_id", marks.alias("mark")).select("conv_id", "mark.*").distinct()
    keys, begun = ["conv_id"], F.min("begun")
    cut = pieces.carry(pieces.by_step(points, "point", PART), keys, {"least": begun}, {"least_behind": F.min("least").over(pieces.later(keys))})
    here = Window.partitionBy("conv_id", pieces.PIECE).orderBy(F.col("point").desc()).rangeBetween(Window.unboundedPreceding, -1)
    taken = cut.withColumn("begun_before", F.least(begun.over(here), "least_behind")).filter("begun IS NULL AND begun_before < point")
    taken = taken.select(F.col("conv_id").alias("taken_conv"), "point")
    return told.join(taken, F.col("conv_id").eqNullSafe(F.col("taken_conv")) & (F.col("at") == F.col("point")), "left_anti")


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, part, formatted and spans (start and stop in code points of the part) of messages(): by seq, then role, text and
    message. A conversation shorter than PART steps has one part."""
    turn = F.struct("at", "role", "text", "message")
    listed = turns.groupBy("conv_id", F.floor(F.col("at") / PART).alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    listed = listed.select("conv_id", "part", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                roles, texts = (batch.column(c)[k].as_py() for c in ("roles", "texts"))
                text, spans = render(list(zip(roles, texts, strict=True)), trained)
                told = pa.array([[{"start": a, "stop": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(k, 1), batch.column("part").slice(k, 1), pa.array([text]), told], names=["conv_id", "part", "formatted", "spans"])

    kind = dict(turns.dtypes)["conv_id"]
    return map_batches(listed, run, f"conv_id {kind}, part long, formatted string, spans array<struct<start: long, stop: long>>")


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (of role, line end, text, line end of each turn), loss_chars and loss_sha256 (of all text in the
    spans), and formatted_chars, read back from formatted(): part after part, so that memory is that of one part."""
    kind = dict(parts.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nobody = object()
        now, state, typ = nobody, None, None

        def done() -> pa.RecordBatch:
            turns, loss, (n, chars, whole) = state
            values = [now, n, turns.hexdigest(), chars, loss.hexdigest(), whole]
            kinds = [typ, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            typ = batch.schema.field("conv_id").type
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True):
                if now is nobody or conv != now:
                    if now is not nobody:
                        yield done()
                    now, state = conv, (hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
                turns, loss, counts = state
                for role, body in read(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    counts[0] += 1
                for span in spans:
                    body = unescaped(text[span["start"] : span["stop"]])
                    loss.update(body.encode())
                    counts[1] += len(body)
                counts[2] += len(text)
        if now is not nobody:
            yield done()

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part"), run, schema)


def log_of(conversations: DataFrame) -> DataFrame:
    """Complete conversations (conv_id, turn, role, text) as a log: each row starts a message of its own and streams its text. Rows
    without a turn come last."""
    event: list[Column] = [F.struct(F.lit("start").alias("kind"), F.col("role").alias("role"), F.lit(None).cast("string").alias("text"))]
    event.append(F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text")))
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(1 << 62)).alias("seq"), "role", "text", F.monotonically_increasing_id().alias("message"))
    return rows.select("conv_id", "seq", "message", F.explode(F.array(*event)).alias("event")).select("conv_id", "seq", "message", "event.*")
