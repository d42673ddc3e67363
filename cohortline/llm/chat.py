"""Chat formatting: any template is rendered turn by turn, and comparing the outputs shows what each turn added."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import table
from cohortline.llm.registry import register

Turn = tuple[str, str]
#: A black box: turns in, text out.
Template = Callable[[list[Turn]], str]

#: Turns that a rendering holds; conversations up to this length are rendered as they are.
WINDOW = 256
MASKED_ROLES = ("assistant",)
ROWS_IN_A_BATCH, CHARS_IN_A_BATCH = 1000, 1 << 22

# The marks of the template below.
HEAD, HEAD_END, FOOT = "<turn ", ">\n", "\n</turn>\n"
_HEADER = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    """A text in which a backslash stands before every backslash and before what looks like a mark."""
    return text.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def marked_turns(turns: list[Turn]) -> str:
    """The template of this module: a header with the role, the text and a footer per turn, all reversible."""
    return "".join(f"{HEAD}{escaped(role).replace('>', chr(92) + '>')}{HEAD_END}{escaped(text)}{FOOT}" for role, text in turns)


class MarkedReader:
    """Reads turns back from what ``marked_turns`` wrote, piece by piece."""

    def __init__(self) -> None:
        self._rest = ""

    def feed(self, piece: str) -> Iterator[Turn]:
        *whole, self._rest = (self._rest + piece).split(FOOT)
        for turn in whole:
            header = _HEADER.match(turn)
            if header is None:
                raise ValueError(f"no header in {turn[:80]!r}")
            yield unescaped(header[1]), unescaped(turn[header.end() :])

    def close(self) -> None:
        if self._rest:
            raise ValueError(f"a turn without end: {self._rest[:80]!r}")


def _shared(one: str, two: str) -> int:
    """Length of the common start of two texts."""
    if two.startswith(one):
        return len(one)
    low, high = 0, min(len(one), len(two))
    while low < high:
        middle = (low + high + 1) // 2
        if one[low:middle] == two[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class Piece:
    """What a turn added to a sample's text; the text is all its pieces, one after the other."""

    sample: int
    position: int
    piece: str
    start: int
    text_start: int | None
    text_end: int | None
    rewrites: bool


def rendered(turns: Iterable[Turn], template: Template, window: int = WINDOW) -> Iterator[Piece]:
    """A piece per turn, from renderings of successive prefixes of the conversation.

    Every prefix is rendered, and once more with another text in its last turn, which shows where in
    the output this text stands. What consecutive outputs share belongs to earlier turns. If it ends before
    the last turn's text does, the template has rewritten history: a new sample begins, whose first piece is
    all of the new output, so each text is learnt in the sample in which it came last. A closing text that
    stands after the last turn only is no history.

    At most ``window`` turns are rendered at once. Where a conversation is longer, the template sees its
    first turn and the last window / 2, and what it made of the last turn is compared: ValueError if it is
    not the same, as such a template needs a larger window.
    """
    held: list[Turn] = []
    out, text_end = template([]), 0  # the newest output, and where its last text ends
    cut = base = sample = 0  # what was given away of the output, and what went before it
    last: Piece | None = None
    for position, (role, text) in enumerate(turns):
        new = template([*held, (role, text)])
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in new)
        probe = template([*held, (role, mark)])
        at = probe.find(mark)
        tail = len(probe) - at - 1
        located = at >= 0 and probe.find(mark, at + 1) < 0 and len(new) >= at + tail
        located = located and new[:at] == probe[:at] and new[len(new) - tail :] == probe[at + 1 :]
        shared = _shared(out, new)
        rewrites = shared < text_end
        if rewrites:
            last.piece = out[cut:]
            yield last
            sample, cut, base = sample + 1, 0, 0
        elif last is not None:
            start = min(shared, at) if located else shared
            last.piece = out[cut:start]
            yield last
            cut = start
        text_end = len(new) - tail if located else len(new)
        last = Piece(
            sample, position, "", base + cut, base + at if located else None, base + text_end if located else None, rewrites
        )
        out = new
        held.append((role, text))
        if len(held) >= max(window, 4):
            before = [held[0], *held[-(max(window, 4) // 2) :]]
            short = template(before)
            begins = len(short) - (len(out) - cut)
            if short[max(begins, 0) :] != out[cut:] or _shared(template(before[:-1]), short) < begins:
                raise ValueError(f"the template looks back more than {max(window, 4) // 2} turns")
            gone = len(out) - len(short)
            held, out, base, cut, text_end = before, short, base + gone, cut - gone, text_end - gone
    if last is not None:
        last.piece = out[cut:]
        yield last


PIECES = (
    "conv_id long, sample int, position int, role string, piece string, start long, loss_start long, loss_end long, "
    "rewrites boolean, located boolean"
)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Conversations of rows in order, each with an iterator over its turns, which has to be used up."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def turns() -> Iterator[Turn]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1:]
                ahead = next(rows, None)

        yield conv, turns()


def formatted(
    conversations: DataFrame, template: Template = marked_turns, roles: tuple[str, ...] = MASKED_ROLES, window: int = WINDOW
) -> DataFrame:
    """A row per turn: ``conv_id, sample, position, role, piece, start, loss_start, loss_end, rewrites, located``.

    The pieces of a sample, by position, are its text; ``start`` is a piece's place in it. The text of a turn
    whose role is one of ``roles`` is under the loss mask from ``loss_start`` to ``loss_end`` (code points of the
    sample's text, end exclusive; null for other roles). A template that rewrites history shows itself by
    ``rewrites``; from there on a new sample counts, so that each text is learnt once, in the output in which
    its turn was the last. ``located`` is false where the template changes the surroundings of a turn with its
    text, which then is under no mask.

    Turns are ordered by ``turn`` (null first), equal ones by role and text; repeated rows are turns of their
    own. Null roles and texts count as empty, rows without conv_id are one conversation. An empty table gives
    an empty result. Texts are shuffled once, by conversation. A task holds ``window`` turns at a time, however
    long a conversation is; rows come by conversation, sample and position.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for conv, turns in _conversations(batches):
            seen: list[str] = []  # roles of turns that have no piece yet

            def noted(turns: Iterator[Turn] = turns, seen: list[str] = seen) -> Iterator[Turn]:
                for role, text in turns:
                    seen.append(role)
                    yield role, text

            for p in rendered(noted(), template, window):
                role, located = seen.pop(0), p.text_start is not None
                span = (p.text_start, p.text_end) if located and role in roles else (None, None)
                rows.append((conv, p.sample, p.position, role, p.piece, p.start, *span, p.rewrites, located))
                size += len(p.piece)
                if len(rows) >= ROWS_IN_A_BATCH or size >= CHARS_IN_A_BATCH:
                    yield _batch(rows, kind)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, kind)

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    kind = conversations.sparkSession.createDataFrame([], PIECES).toArrow().schema
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(pieces, PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Read:
    """What is read of one conversation; digests run along, so its text is never held as a whole."""

    def __init__(self, conv: int | None):
        self.conv, self.reader = conv, MarkedReader()
        self.turns, self.n_turns = hashlib.sha256(), 0
        self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, 0

    def feed(self, piece: str, start: int, low: int | None, high: int | None) -> None:
        for role, text in self.reader.feed(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if low is not None:
            learnt = unescaped(piece[low - start : high - start])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        self.reader.close()
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from texts of ``marked_turns``.

    Reads the rows of ``formatted`` in their order: turns from the text alone, texts to learn through
    the loss mask.
    """
    kind = pieces.sparkSession.createDataFrame([], READ).toArrow().schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Read | None = None
        for batch in batches:
            done = []
            for conv, *piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "start", "loss_start", "loss_end"))):
                if open_ is None or conv != open_.conv:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Read(conv)
                open_.feed(*piece)
            if done:
                yield _batch(done, kind)
        if open_ is not None:
            yield _batch([open_.row()], kind)

    return pieces.mapInArrow(read, READ)


#: A conversation whose texts look like other templates' marks.
ODD_ID, ODD_TEXT = -7, "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS text_out,
         replace(replace(replace(replace(role, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'), '>', '\>') AS role_out
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn >') + 1 + length(role_out) + length(text_out) + length('</turn>') + 2)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@register(ORACLE)
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and an odd one, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(
        [(ODD_ID, 0, "user", ODD_TEXT), (ODD_ID, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string"
    )
    return read_back(formatted(rows.unionByName(odd)))
