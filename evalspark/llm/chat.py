"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: (conv_id, message, seq, kind, role, text). ``open`` begins a message with its role, ``delta`` adds
streamed text, ``edit`` replaces the text so far, ``regenerate`` empties it for another answer, ``delete`` takes the message out. The log is
partitioned by conversation and sorted by message and sequence; a task folds one message at a time and renders it at once, so neither a
conversation nor a group is ever held. Segments come out in order, each with its loss mask as spans of code points.

The template writes ``### role: text</turn>`` and a line end for a turn. In roles and texts a backslash goes before each backslash, ``#`` and ``<``, in roles
before ``:`` too, so that no text can look like a mark and every text comes back as it was. The mask covers assistant texts, not
their marks.

Defined results: null texts are empty, null roles are the empty role. Events of a message are taken by seq, ties by kind, role and text, a
repeated event counts as often as it stands there; text before an ``open`` counts, a later ``open`` changes the role. Messages without number come first;
unknown kinds stop the job with an error. A conversation without id is one conversation of its own.
"""
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
_ESCAPED = re.compile(r"([\\#<])")
_ROLE_ESCAPED = re.compile(r"([\\#<:])")
_PLAIN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)
ORDER = ["conv_id", "message", "seq", "kind", "role", "text"]


def render(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """A turn as written, and the spans (start, end) of code points under the loss mask."""
    head = OPEN + _ROLE_ESCAPED.sub(r"\\\1", role) + ": "
    body = _ESCAPED.sub(r"\\\1", text)
    return head + body + CLOSE, [(len(head), len(head) + len(body))] if role == "assistant" and body else []


def read_turns(written: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in formatted text; ValueError if it is not well formed."""
    at = 0
    while at < len(written):
        m = _TURN.match(written, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield _PLAIN.sub(r"\1", m[1]), _PLAIN.sub(r"\1", m[2])
        at = m.end()


def unescaped(masked: str) -> str:
    return _PLAIN.sub(r"\1", masked)


class Message:
    """Folds the events of one message."""

    def __init__(self):
        self.role, self.parts, self.gone = "", [], False

    def take(self, kind: str, role: str | None, text: str | None) -> None:
        if kind == "open":
            self.role = role or ""
            self.parts.append(text or "")
        elif kind == "delta":
            self.parts.append(text or "")
        elif kind == "edit":
            self.parts = [text or ""]
        elif kind == "regenerate":
            self.parts = []
        elif kind == "delete":
            self.gone = True
        else:
            raise ValueError(f"unknown event: {kind}")


def events_of(rows: DataFrame, chunk: int = 200) -> DataFrame:
    """The log that a finished table (conv_id, turn, role, text) stands for: a message a row, streamed in deltas of ``chunk`` code points.

    Assistant messages begin with a first try that is regenerated; user messages are typed and then edited to what was sent.
    """
    base = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    # Rows of one turn number are messages of their own, in an order that the rows alone decide; equal rows, which may change places, are told apart by a number.
    turn = F.coalesce(F.lpad((F.col("turn").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 21, "0"), F.lit(""))
    named = base.withColumn("message", F.concat_ws("/", turn, "role", F.sha2("text", 256), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.char_length("text") / chunk).cast("int")), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk)))
    event = lambda seq, kind, text: F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), F.col("role").alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    streamed = F.transform(pieces, lambda p, i: event(i + 10, "delta", p))
    tried = F.array(event(F.lit(0), "open", F.lit("")), event(F.lit(1), "delta", F.substring("text", 1, 40)), event(F.lit(2), "regenerate", none))
    typed = F.array(event(F.lit(0), "open", F.substring("text", 1, 40)), event(F.lit(1), "edit", F.col("text")))
    return named.select("conv_id", "message", F.inline(F.when(F.col("role") == "assistant", F.concat(tried, streamed)).otherwise(typed)))


def format_log(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, formatted, loss) in conversation order inside each partition: one segment per message that was not deleted."""
    ordered = events.select(*ORDER).repartition("conv_id").sortWithinPartitions(*ORDER)

    def segments(batches):
        key = now = None
        for b in batches:
            for conv, message, _, kind, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or key != (conv, message):
                    if now is not None and not now.gone:
                        yield (*key, now)
                    key, now = (conv, message), Message()
                now.take(kind, role, text)
        if now is not None and not now.gone:
            yield (*key, now)

    def run(batches):
        held, size = [], 0
        for conv, message, m in segments(batches):
            written, spans = render(m.role, "".join(m.parts))
            held.append({"conv_id": conv, "message": message, "role": m.role, "formatted": written, "loss": [{"start": a, "end": z} for a, z in spans]})
            size += len(written)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
    schema = pa.schema([("conv_id", pa.int64()), ("message", pa.string()), ("role", pa.string()), ("formatted", pa.string()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return ordered.mapInArrow(run, "conv_id bigint, message string, role string, formatted string, loss array<struct<start: bigint, end: bigint>>")


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text reads back as. Reads the segments of format_log as they stand (no shuffle), one at a time."""
    def run(batches):
        key, state = None, None
        out = []
        for b in batches:
            for conv, written, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if state is None or conv != key:
                    if state is not None:
                        out.append(_row(key, state))
                    key, state = conv, {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0}
                for role, text in read_turns(written):
                    state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state["n"] += 1
                for span in loss:
                    text = unescaped(written[span["start"]:span["end"]])
                    state["loss"].update(text.encode("utf-8", "surrogatepass"))
                    state["loss_chars"] += len(text)
                state["chars"] += len(written)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema=_DIGESTS)
                out = []
        if state is not None:
            out.append(_row(key, state))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGESTS)
    return segments.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _row(key, state) -> dict:
    return {"conv_id": key, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss_chars"],
            "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["chars"]}
