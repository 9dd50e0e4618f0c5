r"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

The output of `segments()` is the formatted text in pieces: putting the texts of a conversation together in order gives
the whole, and the pieces with loss = true are what a model is trained on. Control strings inside a text are broken up
with a backslash behind their first character, and backslashes are doubled; `unescape()` undoes both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, segment long, turn long, kind string, text string, loss boolean, valid boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn of each role, where the loss counts, and which role may follow which.

    start is the state before the first turn. A role that `turns` doesn't name is written between `other` with its name
    as a prefix and never counts for the loss; it is no valid turn.
    """

    begin: str = "<s>"
    end: str = "<|end|>"
    turns: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<|reply|>", "</s>")})
    other: tuple = ("<|role|>", "<|says|>", "<|over|>")
    loss: tuple = ("assistant",)
    follows: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)

    @cached_property
    def controls(self) -> list[str]:
        return list(dict.fromkeys([self.begin, self.end, *(m for pair in self.turns.values() for m in pair), *self.other]))

    @cached_property
    def _breaks(self) -> re.Pattern:
        return re.compile("|".join(re.escape(c) for c in ["\\", *sorted(self.controls, key=len, reverse=True)]))

    @cached_property
    def _cuts(self) -> re.Pattern:
        return re.compile("(" + "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True)) + ")")

    def escape(self, text: str) -> str:
        return self._breaks.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def turn(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """The segments of one turn: kind, text, loss."""
        if role in self.turns:
            before, after = self.turns[role]
            return [("open", before, False), ("text", self.escape(text), role in self.loss), ("close", after, False)]
        before, says, over = self.other
        return [("open", before + self.escape(role) + says, False), ("text", self.escape(text), False), ("close", over, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) of a formatted piece that holds whole turns."""
        role, text, named = None, "", False
        opens = {pair[0]: name for name, pair in self.turns.items()}
        closes = {pair[1] for pair in self.turns.values()} | {self.other[2]}
        for part in self._cuts.split(formatted):
            if part in opens and role is None:
                role, text = opens[part], ""
            elif part == self.other[0] and role is None:
                role, text, named = "", "", True
            elif part == self.other[1] and named:
                role, text, named = text, "", False
            elif part in closes:
                yield self.unescape(role or ""), self.unescape(text)
                role = None
            elif part not in (self.begin, self.end):
                text += part


def _ordered(rows: DataFrame) -> DataFrame:
    """Whole conversations in one partition each, turns in order; ties by role, then text. A null turn comes first."""
    few = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return few.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _flush(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turn", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
_NONE = object()
#: Characters of output, with some for each row, that are held before they go on.
HELD = 2_000_000


def _write(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, n, held, valid = _NONE, "start", 0, 0, True
        out: list[tuple] = []

        def end() -> None:
            if conv is not _NONE:
                out.append((conv, n, None, "end", template.end, False, valid and state in template.final))

        for b in batches:
            for c, turn, role, text in _rows(b):
                if c != conv or conv is _NONE:
                    end()
                    conv, state, n, valid = c, "start", 1, True
                    out.append((c, 0, None, "begin", template.begin, False, True))
                valid = valid and role in template.follows.get(state, ())
                state = role
                for kind, piece, loss in template.turn(role, text):
                    out.append((c, n, turn, kind, piece, loss, valid))
                    n += 1
                    held += len(piece) + 64
                if held > HELD:
                    yield _flush(out, _SEGMENTS)
                    out, held = [], 0
        end()
        yield _flush(out, _SEGMENTS)

    return run


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per segment: conv_id, segment (its place), turn, kind, text, loss, valid.

    valid: the machine has accepted every turn of the conversation so far; on the last segment, also that it ends in a
    final state. Nothing is dropped: who wants valid conversations only filters by that flag. Null texts and roles count
    as empty; rows with a null conv_id form one conversation; a null turn comes first; ties are ordered by role and text
    and repeated rows are repeated turns. Rows are streamed and go on by
    size, so that memory is bounded by some megabytes, an input batch and the longest text, whatever a conversation's length.
    """
    return _ordered(conversations).mapInArrow(_write(template), SEGMENTS)


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out, turn = _NONE, [], ""
        n = chars = loss_chars = 0
        whole, lossy = hashlib.sha256(), hashlib.sha256()
        for b in batches:
            for c, _, _, kind, text, loss, valid in _rows(b):
                if kind == "begin":
                    conv, n, chars, loss_chars, turn = c, 0, 0, 0, ""
                    whole, lossy = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                turn += text
                if loss:
                    plain = template.unescape(text)
                    loss_chars += len(plain)
                    lossy.update(plain.encode("utf-8", "surrogatepass"))
                if kind in ("close", "end"):
                    for role, said in template.parse(turn):
                        whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                    turn = ""
                if kind == "end":
                    out.append((conv, n, whole.hexdigest(), loss_chars, lossy.hexdigest(), chars, valid))
            if len(out) > 5000:
                yield _flush(out, _DIGESTS)
                out = []
        yield _flush(out, _DIGESTS)

    return run


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, what can be read from the output of segments(), whose partitions and order it relies on."""
    return formatted.mapInArrow(_read(template), DIGESTS)


def _oracle(template: Template = Template()) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = "replace(text, '\\', '\\\\')"
    for c in template.controls:
        escaped = f"replace({escaped}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
    marks = " ".join(f"WHEN {quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in template.turns.items())
    losses = ", ".join(map(quoted, template.loss))
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), wide AS (
  SELECT *, length({escaped}) + CASE role {marks} ELSE {sum(map(len, template.other))} + length(role) END AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role IN ({losses})), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({losses})), '')) AS loss_sha256,
       (sum(chars) + {len(template.begin) + len(template.end)})::BIGINT AS formatted_chars
FROM wide GROUP BY conv_id
"""


ORACLE = _oracle()
