"""Chat formatting with a black-box template, rendered turn by turn.

A template is any function from turns (role, text) to a string. Successive prefixes of a
conversation are rendered; what an output adds to the one before is the span of the new turn.
If an output doesn't begin with the one before, the template rewrites history: the piece is
marked, and every turn is looked for in its last rendering. A text's place inside its turn is
found without knowing the template: the turn is rendered once more with a character that the
template doesn't hold in the text's place; what stands before and after it brackets the text.

Rows are range-partitioned by conversation and turn, so that a conversation of any length is
dealt to several tasks, and rendered in pieces of ``PIECE`` turns (or ``PIECE_CHARS``), each
after the last ``CONTEXT`` turns before it. A partition may begin inside a conversation: each
partition's first piece is rendered anew when the partitions before it (one row each) show that
it has a context.

``CHATML`` escapes control strings inside texts and roles: ``<``, any backslashes and ``|`` get
one backslash more; a role's line breaks and backslashes are escaped too. Nothing in a text can
end its turn, and ``unescape`` gives the text back.

Defined cases: a null text or role is empty; turns stand in the order of turn (null first),
role, then a hash of the text; rows without a conversation id are one conversation; repeated
rows are turns of their own; a turn whose text the template leaves out has no text span; extra
columns are ignored; an empty table gives no rows. A template that rewrites history or looks
further back than ``CONTEXT`` turns is rendered as a whole only within a piece. Memory is
bounded by ``PIECE`` turns and the longest text. A digest of a whole conversation is one
SHA-256 after another and so one task's stream, read piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch, text_batches

PIECE, PIECE_CHARS, CONTEXT = 32, 4 << 20, 8
Turn = tuple[str, str]
_TURN = pa.struct([("role", pa.string())] + [(c, pa.int32()) for c in ("start", "end", "text_start", "text_end")])
_TAIL = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIELDS = [("conv_id", pa.int64()), ("pid", pa.int32()), ("piece", pa.int32()), ("open", pa.bool_()), ("closing", pa.bool_()), ("whole", pa.bool_()), ("rewrites", pa.bool_()), ("text", pa.string()), ("turns", pa.list_(_TURN)), ("tail", _TAIL), ("raw", pa.list_(pa.string()))]
PIECES = (
    "conv_id long, pid int, piece int, open boolean, closing boolean, whole boolean, rewrites boolean, text string, "
    "turns array<struct<role: string, start: int, end: int, text_start: int, text_end: int>>, tail array<struct<role: string, text: string>>, raw array<string>"
)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


@dataclass(frozen=True)
class Template:
    """A rendering function, and the inverse of what it does to a text."""

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str] = str


def _escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def _unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _chatml(turns: list[Turn]) -> str:
    roles = (_escape(r.replace("\\", "\\\\").replace("\n", "\\n")) for r, _ in turns)
    return "".join(f"<|im_start|>{role}\n{_escape(text)}<|im_end|>\n" for role, (_, text) in zip(roles, turns, strict=True))


CHATML = Template(_chatml, _unescape)


def _probe(render, turns: list[Turn], i: int, out: str, begin: int) -> tuple[int, int] | None:
    """The span in ``out``, the rendering of ``turns``, of turn ``i``'s text."""
    role, text = turns[i]
    blank = render([*turns[:i], (role, ""), *turns[i + 1 :]])
    mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in blank)
    seen = render([*turns[:i], (role, mark), *turns[i + 1 :]])
    at = seen.find(mark, begin)
    end = len(out) - (len(seen) - at - 1)
    if at < 0 or end < at or seen[:at] != out[:at] or seen[at + 1 :] != out[end:]:
        return None
    return at, end


def locate(render, context: list[Turn], turns: list[Turn]) -> tuple[str, list[dict], bool]:
    """(what ``turns`` add to the rendering of ``context``, their spans in it, whether the
    template rewrites history)."""
    base = out = render(context) if context else ""
    spans, done, rewrites = [], list(context), False
    for role, text in turns:
        done.append((role, text))
        now = render(done)
        if not now.startswith(out):
            rewrites = True
            break
        spans.append((role, len(out), len(now), _probe(render, done, len(done) - 1, now, len(out))))
        out = now
    if rewrites:
        done = [*context, *turns]
        out, spans = render(done), []
        if not out.startswith(base):
            base = ""
        for i in range(len(context), len(done)):
            at = _probe(render, done, i, out, 0)
            spans.append((done[i][0], *(at or (None, None)), at))
    b = len(base)
    move = lambda x: None if x is None else x - b
    return out[b:], [{"role": r, "start": move(s), "end": move(e), "text_start": move(at and at[0]), "text_end": move(at and at[1])} for r, s, e, at in spans], rewrites


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _out(rows):
    """Batches of rows of about 4 MB of text, or a single row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[7])
        if size > 4 << 20 or len(held) >= 2000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _pieces(template: Template):
    def rows(it):
        pid = TaskContext.get().partitionId()
        conv, own, context, piece, first = None, [], [], 0, True
        chars, begun = 0, False

        def close(whole, closing):
            text, spans, rewrites = locate(template.render, context, own)
            opens = first and piece == 0
            tail = [{"role": r, "text": t} for r, t in [*context, *own][-CONTEXT:]] if closing else None
            return conv, pid, piece, opens, closing, whole, rewrites, text, spans, tail, [t for _, t in own] if opens else None

        for b in it:
            for part in text_batches([b]):
                for c, role, text in zip(*(part.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                    if begun and c != conv:
                        yield close(piece == 0 and not first, False)
                        own, context, piece, chars, first = [], [], 0, 0, False
                    elif len(own) >= PIECE or chars >= PIECE_CHARS:
                        yield close(False, False)
                        context, own, chars, piece = [*context, *own][-CONTEXT:], [], 0, piece + 1
                    conv, begun = c, True
                    own.append((role, text))
                    chars += len(text)
        if begun:
            yield close(False, True)

    return lambda it: _out(rows(it))


def _again(template: Template):
    """Pieces that begin a partition inside a conversation, after their context."""

    def rows(it):
        for b in it:
            for r in b.to_pylist():
                before = [(t["role"], t["text"]) for tail in r["before"] for t in tail][-CONTEXT:]
                own = [(t["role"], x) for t, x in zip(r["turns"], r["raw"], strict=True)]
                r["text"], r["turns"], r["rewrites"] = locate(template.render, before, own)
                yield tuple(r[n] for n, _ in _FIELDS)

    return lambda it: _out(rows(it))


def format_turns(rows: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pieces of formatted conversations, written and read back: (conv_id, pid, piece, text,
    turns with their spans and their texts' spans in it, rewrites ...); a conversation's pieces
    follow each other by (pid, piece), and its loss mask is the text spans of the assistant."""
    spark = rows.sparkSession
    root = scratch(spark, "chat")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h", "salt"]
    own = own.withColumn("h", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    map_arrow(dealt, _pieces(template), PIECES).write.parquet(f"{root}/pieces")
    pieces = spark.read.schema(PIECES).parquet(f"{root}/pieces")
    # at most two rows a partition: its first piece, and the last turns of its last conversation
    edges = pieces.filter("open or closing").select("conv_id", "pid", "piece", "open", F.when(F.col("closing"), F.col("tail")).alias("tail"))
    so_far = Window.partitionBy("conv_id").orderBy("pid", "piece").rowsBetween(-2 * CONTEXT, -1)
    heads = edges.withColumn("before", F.collect_list("tail").over(so_far)).filter(F.col("open") & (F.size("before") > 0)).select("pid", "before")
    heads.write.parquet(f"{root}/heads")
    heads = spark.read.parquet(f"{root}/heads")
    if heads.isEmpty():
        return pieces
    first = pieces.filter("open").join(heads, "pid").select(*pieces.columns, "before")
    map_arrow(first, _again(template), PIECES).write.parquet(f"{root}/again")
    again = spark.read.schema(PIECES).parquet(f"{root}/again")
    marked = pieces.join(heads.select("pid", F.lit(True).alias("open")), ["pid", "open"], "left_anti")
    return marked.select(pieces.columns).unionByName(again)


def digests(pieces: DataFrame, template: Template = CHATML, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites) of
    formatted conversations, from their pieces."""
    unescape = template.unescape

    def rows(it):
        conv, begun = None, False
        n = chars = loss = 0
        rewrites = False
        turns, masked = sha256(), sha256()
        for b in it:
            for c, text, spans, changed, whole in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "turns", "rewrites", "whole")), strict=True):
                if begun and (c != conv or whole):
                    yield conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars, rewrites
                    n = chars = loss = 0
                    rewrites, turns, masked = False, sha256(), sha256()
                conv, begun = c, True
                rewrites |= changed
                chars += len(text)
                for t in spans:
                    own = "" if t["text_start"] is None else unescape(text[t["text_start"] : t["text_end"]])
                    turns.update(f"{t['role']}\n{own}\n".encode())
                    n += 1
                    if t["role"] == loss_role:
                        loss += len(own)
                        masked.update(own.encode())
        if begun:
            yield conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars, rewrites

    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def run(it):
        held = []
        for row in rows(it):
            held.append(row)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    cols = ["conv_id", "text", "turns", "rewrites", "whole"]
    single = pieces.filter("whole").select(cols)
    several = pieces.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "piece").select(cols)
    return map_arrow(single, run, DIGESTS).unionByName(map_arrow(several, run, DIGESTS))
