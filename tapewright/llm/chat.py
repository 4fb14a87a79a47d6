"""Chat formatting with typed content parts.

A turn is a role and a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, an
attachment becomes a placeholder that names its number in the conversation, and its reference and the count of tokens it
will expand to are recorded. The template:

    <turn role>\\n ...parts... </turn>\\n

Escaping is reversible: a backslash becomes two, `<` becomes `\\<` (in roles also a line feed becomes `\\n` and `>` becomes
`\\>`), so a control string can only come from the template. Assistant text is under the loss mask, attachments are not.

Conversations are written as chunks in order of turn (ties: role, then text, nulls first), about CHUNK characters each, so a
conversation of any length streams through a task in bounded memory; reading back streams the same way. A null role or text
is empty. A null conv_id is a conversation of its own. Repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import kept, table

CHUNK = 1 << 20
KINDS = ("text", "image", "audio", "document")
# Tokens that an attachment expands to: an image by its tiles, sound by its seconds, a document by its pages.
TOKENS_A_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<kind: string, text: string, ref: string, units: int>>"

_ESCAPED = re.compile(r"[\\<]")
_ROLE = re.compile(r"[\\<>\n]")
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>\n]|\\.)*)>\n", re.S)
_BODY = re.compile(r"(?:[^\\<]|\\.|<(?:image|audio|document) [0-9]+>)*", re.S)
_PLACE = re.compile(r"\\.|<(image|audio|document) [0-9]+>", re.S)
CLOSE = "</turn>\n"


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\\" + m[0].replace("\n", "n"), role)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


def unescape_role(role: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


class Flattener:
    """Visits the parts of one conversation's turns."""

    def __init__(self):
        self.attachments: list[dict] = []

    def turn(self, role: str, parts: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted turn and the spans of it that are under the loss mask."""
        out, spans = f"<turn {escape_role(role)}>\n", []
        for part in parts:
            piece = getattr(self, "visit_" + (part["kind"] if part["kind"] in KINDS else "text"))(part)
            if role == "assistant" and part["kind"] not in TOKENS_A_UNIT and piece:
                spans.append((len(out), len(out) + len(piece)))
            out += piece
        return out + CLOSE, spans

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def _attach(self, part: dict) -> str:
        n = len(self.attachments) + 1
        kind, units = part["kind"], part["units"] or 1
        self.attachments.append({"number": n, "kind": kind, "ref": part["ref"], "tokens": units * TOKENS_A_UNIT[kind]})
        return f"<{kind} {n}>"

    visit_image = visit_audio = visit_document = _attach


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
CHUNKS = "conv_id {0}, chunk int, formatted string, loss array<struct<start: bigint, end: bigint>>, attachments array<struct<number: int, kind: string, ref: string, tokens: int>>"


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, role, parts, sorted -> chunks. loss: spans within the chunk's own text."""
    current, visitor, chunk = object(), Flattener(), 0
    text, size, spans, sent = [], 0, [], 0
    kind = None

    def flush():
        nonlocal text, size, spans, sent, chunk
        out = pa.RecordBatch.from_arrays([
            pa.array([current], kind), pa.array([chunk], pa.int32()), pa.array(["".join(text)], pa.string()),
            pa.array([[{"start": a, "end": b} for a, b in spans]], _SPANS), pa.array([visitor.attachments[sent:]], _ATTACHED),
        ], ["conv_id", "chunk", "formatted", "loss", "attachments"])
        text, size, spans, sent, chunk = [], 0, [], len(visitor.attachments), chunk + 1
        return out

    for b in batches:
        kind = b.schema.field(0).type
        for conv, role, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if conv != current:
                if text:
                    yield flush()
                current, visitor, chunk, sent = conv, Flattener(), 0, 0
            turn, loss = visitor.turn(role or "", parts or [])
            if size and size + len(turn) > CHUNK:
                yield flush()
            spans += [(size + a, size + z) for a, z in loss]
            text.append(turn)
            size += len(turn)
    if text:
        yield flush()


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, read from formatted text; placeholders are left out of the text."""
    at = 0
    while at < len(formatted):
        head = _TURN.match(formatted, at)
        body = _BODY.match(formatted, head.end())
        if not formatted.startswith(CLOSE, body.end()):
            raise ValueError(f"not a formatted conversation at {body.end()}")
        yield unescape_role(head[1]), _PLACE.sub(lambda m: "" if m[1] else m[0][1:], body[0])
        at = body.end() + len(CLOSE)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, sorted -> a row for each conversation, in constant memory."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    current, state, kind = object(), None, None

    def row():
        n, whole, loss_n, loss, size = state
        return pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([n], pa.int64()), pa.array([whole.hexdigest()]), pa.array([loss_n], pa.int64()), pa.array([loss.hexdigest()]), pa.array([size], pa.int64())], names)

    for b in batches:
        kind = b.schema.field(0).type
        for conv, text, spans in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if state is None or conv != current:
                if state:
                    yield row()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for s in spans:
                masked = unescape(text[s["start"] : s["end"]])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(text)
    if state:
        yield row()


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts -> conv_id, chunk, formatted, loss, attachments."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = rows.select("conv_id", "role", "parts", "turn", F.expr("transform(parts, p -> p.text)").alias("texts"))
    dealt = order.repartition(_tasks(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "texts")
    return dealt.select("conv_id", "role", "parts").mapInArrow(_formatted, CHUNKS.format(kind))


def as_parts(text) -> F.Column:
    """A text column as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def read_back(chunks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the chunks alone."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    dealt = chunks.select("conv_id", "chunk", "formatted", "loss").repartition(_tasks(chunks), "conv_id").sortWithinPartitions("conv_id", "chunk")
    return dealt.mapInArrow(_digested, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


QUERY = "op4_chat_format"
PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chunks = kept(formatted(rows.select("conv_id", "turn", "role", as_parts(F.col("text")).alias("parts"))), "chat")
    return read_back(chunks)


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) AS shown,
  length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '>', ''), chr(10), '')) AS named FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown + named + length('<turn >') + 1 + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
