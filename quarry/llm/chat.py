"""Chat formatting: a finite-state machine over roles, and segments with loss flags.

A declarative template says how a turn opens and closes and which roles are learned from.
Control strings inside texts are escaped, so the output can be read back exactly. The
segments are written first; what is reported of a conversation is read from them, turn
boundaries found anew in the joined text. Conversations stream in turn order: a worker
holds one turn and running digests, never a whole conversation, however long one is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, pick, small_batches, table

# Which roles may follow which; "" is the start, None the end.
TURN_ORDER = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", None)}


@dataclass(frozen=True)
class Template:
    """How turns are written. {role} is the role's title; learned roles carry loss."""

    opening: str = "### {role}: "
    closing: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    controls: tuple[str, ...] = field(default=("###", "</turn>"))

    def escaped(self, text: str, also: tuple[str, ...] = ()) -> str:
        """Escape characters are doubled, and each control string gets one in front."""
        marks = "|".join(map(re.escape, (self.escape, *self.controls, *also)))
        return re.sub(marks, lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        """Undoes `escaped`: an escape character goes, what follows it stays."""
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) parts of a turn, in order."""
        before, after = self.opening.split("{role}")
        return [(before + self.escaped(role, (after.strip() or after,)) + after, False), (self.escaped(text), role in self.learned), (self.closing, False)]

    def is_closed(self, formatted: str) -> bool:
        """Whether the text ends with a closing that is none of a turn's words: an even run of escapes stands before it."""
        body = formatted.removesuffix(self.closing)
        escapes = len(body) - len(body.rstrip(self.escape))
        return len(body) < len(formatted) and escapes % 2 == 0

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn in formatted output; ValueError where a control string stands in a text as it is."""
        before, after = self.opening.split("{role}")
        controls = "|".join(map(re.escape, (self.closing.strip(), *self.controls)))
        unit = rf"(?:{re.escape(self.escape)}(?:{controls}|.)|(?!{{stop}})[^{re.escape(self.escape)}])*"
        turn = re.compile(re.escape(before) + f"({unit.format(stop=re.escape(after))})" + re.escape(after) + f"({unit.format(stop=controls)})" + re.escape(self.closing), re.S)
        at = 0
        while at < len(formatted):
            if not (found := turn.match(formatted, at)):
                raise ValueError(f"no turn at {at}")
            yield self.unescaped(found[1]), self.unescaped(found[2])
            at = found.end()


class Reader:
    """Reads a conversation's formatted text as it comes, in pieces cut anywhere, and digests what it finds."""

    def __init__(self, template: Template) -> None:
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.state, self.valid, self.first_bad = "", True, None
        self.pending: list[str] = []
        self.learned: list[str] = []

    def add(self, text: str, loss: bool) -> None:
        """The next segment. Turns end where the closing stands unescaped, whatever the segments' own limits."""
        self.chars += len(text)
        self.pending.append(text)
        if loss:
            self.learned.append(text)
        elif text.endswith(self.template.closing):
            self._close()

    def _close(self) -> None:
        """Takes the turns that are whole out of what is pending."""
        text = "".join(self.pending)
        if not self.template.is_closed(text):
            return
        for role, said in self.template.read(text):
            if role not in TURN_ORDER.get(self.state, ()) and self.valid:
                self.valid, self.first_bad = False, self.n
            self.state = role
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n += 1
        plain = self.template.unescaped("".join(self.learned))
        self.loss.update(plain.encode())
        self.loss_chars += len(plain)
        self.pending, self.learned = [], []

    def row(self, conv: int | None) -> tuple:
        if self.pending:
            raise ValueError(f"conversation {conv} ends inside a turn")
        valid = self.valid and None in TURN_ORDER.get(self.state, ())
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid, self.first_bad


COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid_order boolean, first_bad_turn long"
SEGMENT_COLUMNS = "conv_id long, turn long, position int, text string, loss boolean"


def in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, each conversation in one partition, by turn.

    Null texts and roles are empty. Turns that are equal follow role, then text; null turns
    come last. Rows with a null conv_id form one conversation. Rows that repeat are turns
    each.
    """
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").fillna("", ["role", "text"])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """The training text: a row per segment, in order, with its loss flag; columns other than the four are ignored."""
    template = template or Template()

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(c, t, k, text, loss) for c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) for k, (text, loss) in enumerate(template.segments(r, x))]
        return _batch(rows, SEGMENT_COLUMNS)

    small_batches(conversations.sparkSession)
    return map_arrow(in_order(conversations), emit, SEGMENT_COLUMNS)


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    named = [x.split() for x in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(map(list, zip(*rows, strict=True)), named, strict=True)], names=[n for n, _ in named])


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: digests read back from its segments, and whether its order is valid.

    Reads conv_id, turn, role and text; other columns are ignored. Very long texts are one
    turn in memory. An empty table gives no rows. The digests of a conversation run through
    its text in order, which no two workers can share: one conversation is one worker's, a
    turn in memory, at the speed of sha256.
    """
    template = template or Template()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader, rows = None, None, []
        for batch in batches:
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if reader is None or conv != current:
                    if reader is not None:
                        rows.append(reader.row(current))
                    current, reader = conv, Reader(template)
                reader.add(text, loss)
            if len(rows) >= 1000:
                yield _batch(rows, COLUMNS)
                rows = []
        if reader is not None:
            yield _batch([*rows, reader.row(current)], COLUMNS)

    return segments(conversations, template).mapInArrow(fold, COLUMNS)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    return formatted(rows.unionByName(extra))


#: DuckDB: the digests straight from the turns; formatted_chars counts openings, closings and escapes.
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g')) AS escaped,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS k,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS FIRST, role DESC, text DESC) = 1 AS is_last FROM c),
f AS (
  SELECT *, NOT coalesce(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' END, false) AS bad FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + escaped + 8) AS BIGINT) AS formatted_chars,
  NOT bool_or(bad) AND bool_or(is_last AND role = 'assistant') AS valid_order,
  CAST(min(k) FILTER (bad) AS BIGINT) AS first_bad_turn
FROM f GROUP BY conv_id
"""
