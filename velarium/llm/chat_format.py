"""Chat formatting: incremental black-box rendering.

A template is any function from a list of turns (role, text) to a string. Each conversation is
rendered prefix by prefix; comparing consecutive outputs gives the span that each turn added, and an
output that doesn't start with the one before it shows a template that rewrites history. Inside a
turn's span, the frame that the template puts around a text is found by rendering the turn with two
probe texts of one character each.

Whole prefixes are rendered, in time that grows with the square of a conversation's turns. For a template
that is declared local (no turn's output depends on turns further back), or where a window is asked for, the
prefix beyond `window` turns is the first turn and the last window / 2 to window turns, so that time and
memory stay bounded; for such templates the outputs are the same.

Defined cases: a null text or role is empty; rows of one conversation and turn come in order of role,
then text, and each is a turn of its own; null turns come first; a null conversation is one of its
own; an empty table gives an empty result; a template that rewrites history raises RewritesHistory, or
marks the rows if asked to; a very long text is rendered whole; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import partitions

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
WINDOW = 64
PROBES = ("0", "1")
SEGMENTS = "conv_id long, turn_index long, role string, segment string, text_start long, text_end long, loss boolean, rewrites boolean"


class RewritesHistory(ValueError):
    """A template's output for a longer prefix doesn't start with its output for a shorter one."""


def escape(text: str) -> str:
    """Puts `\\` after the first character of each `<|`, and of each `<\\..\\|` already there. unescape() undoes it."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def chatml(turns: list[Turn]) -> str:
    """Marks turns by control strings; these can't occur inside roles or texts, whose `<|` are escaped."""
    return "".join(f"{OPEN}{escape(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


chatml.local = True


class Renderer:
    """Spans of the turns of one conversation, as they come."""

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window = template, window
        self.turns: list[Turn] = []
        self.last = template([])

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """The turn's segment, where its text is in it, and whether the template rewrote what it had put out."""
        if self.window is not None and len(self.turns) >= self.window:
            self.turns = [self.turns[0], *self.turns[1 - self.window // 2 :]]
            self.last = self.template(self.turns)
        before = self.last
        probes = [self.template([*self.turns, (role, probe)]) for probe in PROBES]
        self.turns.append((role, text))
        self.last = self.template(self.turns)
        if not all(out.startswith(before) for out in (self.last, *probes)):
            return self.last, 0, 0, True
        segment, (one, other) = self.last[len(before) :], (out[len(before) :] for out in probes)
        # The probes differ in their only character, so what they have in common is the frame, whatever a text begins or ends with.
        start, end = _common(one, other), _common(one[::-1], other[::-1])
        if len(segment) < start + end or segment[:start] != one[:start] or segment[len(segment) - end :] != one[len(one) - end :]:
            raise ValueError("the template's frame depends on the text")
        return segment, start, len(segment) - end, False


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def format_turns(conversations: DataFrame, template: Template = chatml, loss_roles: tuple[str, ...] = ("assistant",), window: int | None = None, on_rewrite: str = "raise") -> DataFrame:
    """A row for each turn, in order inside each partition: its segment of the output, the place of its text in it, the loss flag.

    The output of a conversation is its segments joined. All rows of a conversation are in one
    partition, next to each other. Whole prefixes are rendered, in time that grows with the square of the
    turns, unless a window is given or the template is declared local (an attribute `local`: no turn's output
    depends on turns further back); then it is streamed, never held whole.
    """
    if window is None and getattr(template, "local", False):
        window = WINDOW
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, renderer, index = object(), None, 0
        for batch in batches:
            out = [[] for _ in range(8)]
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != current or renderer is None:
                    current, renderer, index = conv, Renderer(template, window), 0
                segment, start, end, rewrites = renderer.add(role, text)
                if rewrites and on_rewrite == "raise":
                    raise RewritesHistory(f"conversation {conv}, turn {index}")
                for column, value in zip(out, (conv, index, role, segment, start, end, role in loss_roles, rewrites), strict=True):
                    column.append(value)
                index += 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return dealt.mapInArrow(render, SEGMENTS)


_SEGMENT = re.compile(re.escape(OPEN) + r"(.*?)\n(.*)" + re.escape(CLOSE) + r"\n", re.S)


def parse_chatml(segment: str) -> Turn:
    """Role and text back from a turn's segment; a role's line break can't occur, as roles are single words."""
    match = _SEGMENT.fullmatch(segment)
    if not match:
        raise ValueError("not a turn")
    return unescape(match[1]), unescape(match[2])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame, parse: Callable[[str], Turn] = parse_chatml) -> DataFrame:
    """conv_id and sums over what is read back from the segments: a row for each conversation. Takes format_turns()'s rows as dealt there."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current, n, size, chars = None, 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        pack = lambda: pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in zip(names, zip(*done, strict=True) if done else [[]] * 6, strict=True)})
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
                conv, index, segment, start, end, masked = row
                if index == 0 and n:
                    done.append((current, n, turns.hexdigest(), size, loss.hexdigest(), chars))
                    n, size, chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse(segment)
                turns.update(f"{role}\n{text}\n".encode())
                if masked:
                    text = unescape(segment[start:end])
                    loss.update(text.encode())
                    size += len(text)
                current, n, chars = conv, n + 1, chars + len(segment)
            if len(done) > 10_000:
                yield pack()
                done = []
        if n:
            done.append((current, n, turns.hexdigest(), size, loss.hexdigest(), chars))
        yield pack()

    return segments.mapInArrow(fold, DIGESTS)
