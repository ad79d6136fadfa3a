"""Chat formatting into budgeted, turn-aligned training windows with a loss mask.

Turns of a conversation are laid end to end; running sums of their tokens choose the spans. A new
window starts when the next turn would pass the budget. Each later window repeats the leading system
turn and the last ``history`` turns that fit ``history_tokens``; repeated turns are never under the
loss mask, so every assistant text is a target exactly once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts every ``<``,
k backslashes, ``|`` gets one backslash more, so no control string can appear there; taking one away
restores the text. In roles, backslashes and line ends are escaped first.

Conversations are streamed: rows are partitioned by conversation and sorted by turn, and only the
current window and its history are in memory, however long the conversation is.

Defined results: NULL text or role is empty; a NULL conversation id is one conversation; a NULL turn
sorts first; repeated turns are all kept, ordered by (turn, role, text). A turn longer than the budget
is kept whole in a window of its own (``over_budget``). An empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import whole

START, END = "<|im_start|>", "<|im_end|>\n"
WINDOWS = (
    "conv_id long, window int, text string, first_turn int, n_turns int, n_repeated int, n_tokens int, "
    "over_budget boolean, loss_starts array<int>, loss_ends array<int>"
)
_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
}
_TOKEN = re.compile(r"\w+|[^\w\s]")
_ROLE = {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(re.sub(r"[\\\n\r]", lambda m: _ROLE[m.group()], role))


def unescape_role(role: str) -> str:
    back = {v[1]: k for k, v in _ROLE.items()}
    return re.sub(r"\\([\\nr])", lambda m: back[m.group(1)], unescape(role))


def count_tokens(text: str) -> int:
    """Words and punctuation marks: the default measure of the budget."""
    return sum(1 for _ in _TOKEN.finditer(text))


class _Windows:
    """Windows of one conversation, built turn by turn."""

    def __init__(self, conv, budget: int, history: int, history_tokens: int, measure: Callable[[str], int]):
        self.conv, self.budget, self.measure = conv, budget, measure
        self.history, self.history_tokens = history, history_tokens
        self.system: tuple | None = None
        self.turns: list[tuple] = []  # (index, role, piece, target length, tokens) in the open window
        self.repeated = 0
        self.prefix = [0]  # running token sums of the open window
        self.seen = self.number = 0

    def add(self, role: str, text: str):
        body, head = escape(text), f"{START}{escape_role(role)}\n"
        turn = (self.seen, role, head + body + END, len(head), len(body), self.measure(text) + self.measure(role) + 2)
        if self.seen == 0 and role == "system":
            self.system = turn
        self.seen += 1
        if len(self.turns) > self.repeated and self.prefix[-1] + turn[5] > self.budget:
            yield self.close()
            self.reopen(turn[5])
        self.push(turn)

    def push(self, turn: tuple) -> None:
        self.turns.append(turn)
        self.prefix.append(self.prefix[-1] + turn[5])

    def reopen(self, needed: int) -> None:
        """Start the next window: system turn, then as much recent history as both limits allow."""
        fixed = [self.system] if self.system else []
        room = min(self.history_tokens, self.budget - needed - sum(t[5] for t in fixed))
        past = [t for t in self.turns if t is not self.system][-self.history :] if self.history else []
        while past and sum(t[5] for t in past) > room:
            past.pop(0)
        self.turns, self.prefix = [], [0]
        for turn in fixed + past:
            self.push(turn)
        self.repeated = len(self.turns)

    def close(self) -> tuple:
        text, starts, ends, at = [], [], [], 0
        for i, (_, role, piece, offset, length, _) in enumerate(self.turns):
            if i >= self.repeated and role == "assistant":
                starts.append(at + offset)
                ends.append(at + offset + length)
            text.append(piece)
            at += len(piece)
        row = (
            self.conv, self.number, "".join(text), self.turns[self.repeated][0], len(self.turns), self.repeated,
            self.prefix[-1], self.prefix[-1] > self.budget, starts, ends,
        )
        self.number += 1
        return row


def _ordered(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows as exact Python values (longs beside a NULL stay whole numbers)."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def windows(
    conversations: DataFrame,
    budget: int = 512,
    history: int = 2,
    history_tokens: int = 128,
    measure: Callable[[str], int] = count_tokens,
) -> DataFrame:
    """Formatted windows of all conversations (columns conv_id, turn, role, text; others are ignored)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for conv, turns in groupby(_ordered(batches, ["conv_id", "role", "text"]), key=lambda r: r[0]):
            made = _Windows(conv, budget, history, history_tokens, measure)
            for _, role, text in turns:
                rows.extend(made.add(role, text))
                if len(rows) >= 1000:
                    yield _batch(rows, WINDOWS)
                    rows = []
            rows.append(made.close())
        if rows:
            yield _batch(rows, WINDOWS)

    turns = conversations.select(F.col("conv_id").cast("long"), "turn", whole("role").alias("role"), whole("text").alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(build, WINDOWS)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted window: role, text, and where the escaped text starts and ends."""
    turns, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        turns.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end]), line + 1, end))
        at = end + len(END)
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, from its windows alone: new turns in order, text under the mask."""
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_windows long"
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        columns = ["conv_id", "text", "n_repeated", "loss_starts", "loss_ends"]
        for conv, parts in groupby(_ordered(batches, columns), key=lambda r: r[0]):
            turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = n_windows = 0
            for _, text, repeated, starts, ends in parts:
                for role, body, _, _ in parse(text)[repeated:]:
                    turns_hash.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    n_turns += 1
                for start, end in zip(starts, ends, strict=True):
                    target = unescape(text[start:end])
                    loss_hash.update(target.encode("utf-8", "surrogatepass"))
                    loss_chars += len(target)
                chars += len(text)
                n_windows += 1
            rows.append((conv, n_turns, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, n_windows))
            if len(rows) >= 5000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    kept = formatted.select("conv_id", "window", "text", "n_repeated", "loss_starts", "loss_ends")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(digest, schema)
