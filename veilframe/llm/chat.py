"""Chat formatting: turn-aligned windows under a token budget, with loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import Scratch

#: Fixed values of the template: what opens a turn of each role and what closes it.
OPEN = {"system": "<<SYS>>\n", "user": "[INST] ", "assistant": "[/INST] "}
OTHER = "[ROLE:{}] "
CLOSE = "</s>"
#: What escapes a character inside texts.
ESCAPE = "\\"
#: Tokens of a segment: a longer conversation is dealt to tasks in segments of about so many.
SEGMENT_TOKENS = 1 << 18

_ESCAPED = re.compile(r"[<\[\\\]]")
_UNESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Put a backslash before every character that could begin or end a control string."""
    return _ESCAPED.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def head_of(role: str) -> str:
    return OPEN.get(role) or OTHER.format(escape(role))


def framed(role: str, text: str) -> str:
    """A turn as it stands in a window, with its control strings."""
    return head_of(role) + escape(text) + CLOSE


@dataclass
class Window:
    """One formatted span: its text, the character spans that count in the loss, and which turns are new in it."""

    text: list[str] = field(default_factory=list)
    size: int = 0
    tokens: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    new: list[int] = field(default_factory=list)
    turn_at: list[int] = field(default_factory=list)

    def add(self, position: int, role: str, text: str, tokens: int, repeated: bool) -> None:
        head, body = head_of(role), escape(text)
        self.turn_at.append(self.size)
        if not repeated:
            self.new.append(position)
            if role == "assistant":
                self.spans.append((self.size + len(head), self.size + len(head) + len(body)))
        self.text += [head, body, CLOSE]
        self.size += len(head) + len(body) + len(CLOSE)
        self.tokens += tokens


def windows(turns: list[tuple[int, str, str, int]], system: tuple[str, int] | None, before: int, budget: int, history: int) -> Iterator[Window]:
    """Windows of a run of turns ``(position, role, text, tokens)``, the first ``before`` of which are only there to be repeated.

    With s the prefix sums of turn tokens, a window that begins with turn i ends before the first turn j
    with s[j+1] - s[i] + (repeated tokens) > budget; both that and how far back the repeated turns reach
    are looked up in s. Repeated are the system turn, if it takes at most half of the budget and leaves
    room for turn i, and as many of the turns before i as fit into ``history`` tokens and the room that
    is left. A single turn above the budget has a window of its own.
    """
    s = np.r_[0, np.cumsum([n for *_, n in turns], dtype=np.int64)]
    i = before
    while i < len(turns):
        window, own = Window(), int(s[i + 1] - s[i])
        if turns[i][0] > 0:
            room = budget - own
            if system is not None and 2 * system[1] <= budget and system[1] <= room:
                window.add(0, "system", system[0], system[1], True)
                room -= system[1]
            first = int(np.searchsorted(s, s[i] - max(0, min(history, room))))
            if system is not None and turns[0][0] == 0:
                first = max(first, 1)
            for turn in turns[first:i]:
                window.add(*turn, True)
        end = max(i + 1, int(np.searchsorted(s, s[i] + budget - window.tokens, "right")) - 1)
        for turn in turns[i:end]:
            window.add(*turn, False)
        yield window
        i = end


FORMATTED = (
    "conv_id long, segment long, window long, whole boolean, formatted string, n_tokens long, new_turns array<long>, turn_starts array<int>,"
    " loss_starts array<int>, loss_ends array<int>"
)


def counted(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, turn, role, text`` and the ``tokens`` of each turn with its control strings, which are one at least."""
    from veilframe.llm.counts import counter

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch[k : k + 500]
                n = count([framed(r, t) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([max(1, x) for x in n], pa.int64())], names=["conv_id", "turn", "role", "text", "tokens"])

    return turns.mapInArrow(run, "conv_id long, turn long, role string, text string, tokens long")


def segments(slim: DataFrame, size: int, history: int) -> DataFrame:
    """``row, segment, position, own`` of long conversations from ``no_id, conv_id, turn, role, tie, row, tokens``.

    A turn belongs to the segment in which, by the prefix sums of tokens, it begins. Each segment also
    has the conversation's system turn and what of the segment before may be repeated. These rows have
    no texts, so that a conversation's pass through one task as a stream.
    """

    def run(batches):
        conv, total, at, system, recent = None, 0, 0, None, []
        for batch in batches:
            out: list[tuple] = []
            none, ids, _, roles, _, rows, tokens = (c.to_pylist() for c in batch.columns)
            for key, role, row, n in zip(zip(none, ids, strict=True), roles, rows, tokens, strict=True):
                if key != conv:
                    conv, total, at, system, recent = key, 0, 0, None, []
                k = total // size
                if k and k > (total - recent[-1][2]) // size:
                    left = history
                    for other, position, m in reversed(recent):
                        left -= m
                        if left < 0:
                            break
                        if position or system is None:
                            out.append((other, k, position, False))
                    if system is not None:
                        out.append((system, k, 0, False))
                out.append((row, k, at, True))
                if at == 0 and role == "system":
                    system = row
                recent.append((row, at, n))
                if len(recent) > 2 * history + 2:  # each turn has one token at least
                    del recent[: -history - 1]
                total, at = total + n, at + 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["row", "segment", "position", "own"])

    order = ["no_id", "conv_id", "turn", "role", "tie", "row"]
    dealt = slim.repartition("no_id", "conv_id").sortWithinPartitions(*order)
    return dealt.select(*order, "tokens").mapInArrow(run, "row long, segment long, position long, own boolean")


def format_chats(
    scratch: Scratch, turns: DataFrame, tokenizer: str, budget: int = 1024, history: int = 256,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """Format conversations into windows: ``conv_id, segment, window, whole, formatted, n_tokens, new_turns, turn_starts, loss_starts, loss_ends``.

    Rows of a conversation are ordered by turn, then role, then a hash of the text, so repeated rows are
    turns of their own. ``n_tokens`` counts the turns with their control strings, each turn by itself,
    and no window has more than ``budget`` of them but that of a single longer turn. Tokens are counted
    before anything is shuffled. Conversations of at most ``segment_tokens`` are dealt whole; longer ones are cut
    where their prefix sums of tokens pass a multiple of it, and their segments are dealt one by one, so
    a conversation with a third of all rows meets in one task only as rows without texts.

    Null text and null role count as empty; rows whose conversation id is null form one conversation;
    null turns come first. A turn without text still takes the tokens of its control strings. A system
    turn above half of the budget isn't repeated. ``segment, window`` order a conversation's windows and
    ``whole`` says that it has one segment. ``new_turns`` are positions (from 0) of the turns that a
    window has for the first time; ``loss_*`` are character offsets of the assistant texts among them.
    Within a partition the windows of a segment come out in order. Other columns are ignored; an empty table gives no rows.
    """
    plain = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = counted(plain, tokenizer).select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("conv_id"), "turn", "role", "text", "tokens",
        F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.table(rows, "turns", "zstd")
    key = ["no_id", "conv_id"]
    long = scratch.table(rows.groupBy(*key).agg(F.sum("tokens").alias("n")).where(F.col("n") > segment_tokens).select(*key), "long")
    cut = scratch.table(segments(rows.drop("text").join(long, key, "left_semi"), segment_tokens, history), "segments")
    short = rows.join(long, key, "left_anti").withColumns({"segment": F.lit(0).cast("long"), "position": F.lit(None).cast("long"), "own": F.lit(True), "whole": F.lit(True)})
    parts = rows.join(long, key, "left_semi").join(cut, "row").withColumn("whole", F.lit(False))
    columns = [*key, "segment", "own", "position", "whole", "turn", "role", "tie", "row", "tokens", "text"]
    dealt = short.select(*columns).union(parts.select(*columns)).repartition(*key, "segment")
    dealt = dealt.sortWithinPartitions(*key, "segment", "position", "turn", "role", "tie", "row")

    def run(batches):
        held: list[tuple[int, str, str, int]] = []
        before, now = 0, None

        def close() -> list[tuple]:
            if now is None:
                return []
            none, conv, segment, whole = now
            system = (held[0][2], held[0][3]) if held[0][0] == 0 and held[0][1] == "system" else None
            found = windows(held, system, before, budget, history)
            return [
                (None if none else conv, segment, k, whole, "".join(w.text), w.tokens, w.new, w.turn_at, [a for a, _ in w.spans], [b for _, b in w.spans])
                for k, w in enumerate(found)
            ]

        for batch in batches:
            out: list[tuple] = []
            none, convs, parts, owns, positions, wholes, _, roles, _, _, tokens, texts = (c.to_pylist() for c in batch.columns)
            for this, own, position, role, text, n in zip(zip(none, convs, parts, wholes, strict=True), owns, positions, roles, texts, tokens, strict=True):
                if this != now:
                    out += close()
                    held, before, now = [], 0, this
                before += not own
                held.append((len(held) if position is None else position, role, text, n))
            yield _table(out)
        yield _table(close())

    return dealt.select(*columns).mapInArrow(run, FORMATTED)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), longs, ints, ints, ints]
    names = ["conv_id", "segment", "window", "whole", "formatted", "n_tokens", "new_turns", "turn_starts", "loss_starts", "loss_ends"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


_HEAD = re.compile("|".join(["(?P<system>" + re.escape(OPEN["system"]) + ")", "(?P<user>" + re.escape(OPEN["user"]) + ")",
                             "(?P<assistant>" + re.escape(OPEN["assistant"]) + ")", r"\[ROLE:(?P<other>(?:\\.|[^\]\\])*)\] "]), re.S)


def parse_turn(formatted: str, start: int, end: int) -> tuple[str, str]:
    """Role and unescaped text of the turn that spans these characters of a formatted window."""
    head = _HEAD.match(formatted, start, end)
    if head is None or formatted[end - len(CLOSE) : end] != CLOSE:
        raise ValueError(f"no turn at {start}: {formatted[start : start + 40]!r}")
    role = unescape(head["other"]) if head["other"] is not None else head.lastgroup
    return role, unescape(formatted[head.end() : end - len(CLOSE)])


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


#: What a window says of its conversation, or all of it (``done``): texts to be hashed, or their hashes.
PIECES = (
    "conv_id long, segment long, window long, done boolean, n_turns long, turns binary, turns_sha256 string,"
    " loss_chars long, loss binary, loss_sha256 string, formatted_chars long"
)


def window_pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``conv_id, segment, window, whole, n_turns, turns, loss_chars, loss, formatted_chars`` of each window."""
    for conv, segment, k, whole, text, new, at, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        bounds = [*at, len(text)]
        turns = [parse_turn(text, bounds[i], bounds[i + 1]) for i in range(len(at) - len(new), len(at))]
        loss = [unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)]
        said = "".join(f"{role}\n{body}\n" for role, body in turns).encode("utf-8", "surrogatepass")
        yield conv, segment, k, whole, len(turns), said, sum(map(len, loss)), "".join(loss).encode("utf-8", "surrogatepass"), len(text)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What the formatted windows say, per conversation: the turns and the text under the loss mask.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Reads nothing but
    ``formatted`` and the offsets. ``in_order`` says that the windows come straight from
    ``format_chats``: those of a ``whole`` conversation follow each other and are hashed where they are.
    The windows of others go to one task for each conversation, which hashes them as a stream: a hash of
    a text in order can't be taken in parts.
    """
    columns = ["conv_id", "segment", "window", "whole", "formatted", "new_turns", "turn_starts", "loss_starts", "loss_ends"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64())
    names = [c.split()[0] for c in PIECES.split(", ")]

    def first(batches):
        state: list | None = None

        def close() -> list[tuple]:
            if state is None:
                return []
            conv, n, digest, chars, loss, size = state
            return [(conv, 0, 0, True, n, None, digest.hexdigest(), chars, None, loss.hexdigest(), size)]

        for batch in batches:
            out: list[tuple] = []
            for conv, segment, k, whole, n, said, chars, loss, size in window_pieces(batch):
                if not (whole and in_order):
                    out.append((conv, segment, k, False, n, said, None, chars, loss, None, size))
                    continue
                if k == 0:
                    out += close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(said)
                state[3] += chars
                state[4].update(loss)
                state[5] += size
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in close()], t) for i, t in enumerate(kinds)], names=names)

    def second(batches):
        state: list | None = None

        def close() -> list[list]:
            return [] if state is None else [[state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]]

        for batch in batches:
            out: list[list] = []
            for conv, segment, k, done, n, said, said_hash, chars, loss, loss_hash, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if done:
                    out.append([conv, n, said_hash, chars, loss_hash, size])
                    continue
                if segment == 0 and k == 0:
                    out += close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(said)
                state[3] += chars
                state[4].update(loss)
                state[5] += size
            yield _summary(out)
        yield _summary(close())

    pieces = formatted.select(*columns).mapInArrow(first, PIECES)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window").mapInArrow(second, SUMMARY)


def _summary(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
