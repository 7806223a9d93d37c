"""Chat formatting with any template as a black box: spans are found by rendering successive prefixes of a conversation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Turns of a conversation that are rendered again when the first part of a long one is handed on.
BLOCK = 64
#: Characters of text in one Arrow batch, about.
BATCH = 4_000_000
PIECE = "conv_id long, nth long, role string, piece string, start long, text_start long, text_end long, rewritten boolean"

Turn = tuple[str, str]


@dataclass(frozen=True)
class Template:
    """``render`` gives the text of a list of (role, text); nothing else is known of it. ``read`` gives (role, text) of
    one turn's piece of it, ``plain`` a text as it was before ``render`` put it in."""

    render: Callable[[list[Turn]], str]
    read: Callable[[str], Turn]
    plain: Callable[[str], str]


# fixed values: the marks of the bracket format
BEGIN, CLOSE = "<s>", "</s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("", CLOSE), "system": ("<<SYS>>\n", "\n<</SYS>>")}
OTHER, OTHER_TEXT, OTHER_END = "[ROLE]", "[/ROLE]", "[/TURN]"
CONTROLS = (BEGIN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", OTHER, OTHER_TEXT, OTHER_END)

#: A control string, or one that was escaped before: backslashes after its first character.
STRING = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS)
CONTROL, ESCAPED = re.compile(STRING), re.compile(STRING.replace(r"\\*", r"\\+"))


def escape(text: str) -> str:
    """One backslash more in each control string: no control string is left, and ``unescape`` takes it out again."""
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def bracketed(turns: list[Turn]) -> str:
    out = [BEGIN] if turns else []
    for role, text in turns:
        before, after = MARKS.get(role) or (f"{OTHER}{escape(role)}{OTHER_TEXT}", OTHER_END)
        out += [before, escape(text), after]
    return "".join(out)


def read_bracketed(piece: str) -> Turn:
    piece = piece.removeprefix(BEGIN)
    if piece.startswith(OTHER):
        role, text = piece.removeprefix(OTHER).removesuffix(OTHER_END).split(OTHER_TEXT, 1)
        return unescape(role), unescape(text)
    role = next(r for r, (before, after) in MARKS.items() if before and piece.startswith(before)) if piece.startswith((MARKS["user"][0], MARKS["system"][0])) else "assistant"
    return role, unescape(piece.removeprefix(MARKS[role][0]).removesuffix(MARKS[role][1]))


BRACKETS = Template(bracketed, read_bracketed, unescape)


def common(a: str, b: str) -> int:
    """Length of the common prefix: whole strings are compared by halves."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class Conversation:
    """The turns of one conversation as they come, and where they stand in what the template makes of them so far."""

    def __init__(self, template: Template, conv: int | None, block: int):
        self.render, self.conv, self.block = template.render, conv, block
        self.turns: list[Turn] = []
        self.out = ""  # all turns held, rendered
        self.base = self.nth = self.sent = 0  # characters and turns before those held; turns held that were handed on
        self.ends: list[int] = []  # by turn held: where its piece ends, its text stands, whether it was rewritten
        self.texts: list[tuple[int, int] | None] = []
        self.rewritten: list[bool] = []

    def add(self, role: str, text: str) -> None:
        held = self.turns
        now = self.render([*held, (role, text)])
        same = common(self.out, now)
        if same < len(self.out):  # the template has rewritten what it gave for earlier turns
            if self.sent and same < self.ends[0]:
                raise ValueError(f"conversation {self.conv}: turn {self.nth + len(held)} rewrites turns that were handed on")
            for k, end in enumerate(self.ends):
                if end > same:
                    self.ends[k], self.texts[k], self.rewritten[k] = same, None, True
        # where the turn's text stands: two probes in its place differ in one character
        x, y = self.render([*held, (role, "x")]), self.render([*held, (role, "y")])
        at = common(x, y)
        after = x[at + 1 :]
        told = at < len(x) and y[at + 1 :] == after and len(now) >= at + len(after) and now.startswith(x[:at]) and now.endswith(after)
        self.turns.append((role, text))
        self.out = now
        self.ends.append(len(now))
        self.texts.append((at, len(now) - len(after)) if told else None)
        self.rewritten.append(False)

    def rows(self, upto: int) -> list[tuple]:
        out = []
        for k in range(self.sent, upto):
            begin, end = self.ends[k - 1] if k else 0, self.ends[k]
            span = self.texts[k]
            if span is None or not begin <= span[0] <= span[1] <= end:
                where = (None, None)
            else:
                where = (self.base + span[0], self.base + span[1])
            out.append((self.conv, self.nth + k, self.turns[k][0], self.out[begin:end], self.base + begin, *where, self.rewritten[k]))
        return out

    def handed_on(self) -> list[tuple]:
        """Rows of the first half of the turns held, if nothing was rewritten and the others render alone as they do now;
        else none, and all stay. The last turn handed on is held as the first, since it may open a text."""
        n = len(self.turns) - self.block
        if n < self.block or any(self.rewritten):
            return []
        first, alone = self.render(self.turns[n : n + 1]), self.render(self.turns[n:])
        if not alone.startswith(first) or alone[len(first) :] != self.out[self.ends[n] :]:
            return []
        out, shift = self.rows(n + 1), self.ends[n] - len(first)
        self.turns, self.out, self.sent = self.turns[n:], alone, 1
        self.base, self.nth = self.base + shift, self.nth + n
        self.ends = [e - shift for e in self.ends[n:]]
        self.texts = [t and (t[0] - shift, t[1] - shift) for t in self.texts[n:]]
        self.rewritten = self.rewritten[n:]
        return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "nth": pa.int64(), "role": pa.string(), "piece": pa.string(), "start": pa.int64(), "text_start": pa.int64(), "text_end": pa.int64(), "rewritten": pa.bool_()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def pieces(convs: DataFrame, template: Template = BRACKETS, block: int = BLOCK) -> DataFrame:
    """One row a turn: conv_id, nth, role, piece, start, text_start, text_end, rewritten; a conversation's rows stand
    together and in order, and their pieces joined are its formatted text. Offsets are of that text.

    ``convs``: rows (conv_id, turn, role, text); turns by turn (null first), then role and text; null roles and texts
    are empty, rows without a conv_id are one conversation, repeated rows are turns of their own, other columns are
    ignored. The template is rendered for each prefix of a conversation in turn. Where an output begins with the one
    before it, what it has more is the turn's piece. Where it doesn't, the template rewrites history: of the turns
    whose pieces have changed, ``rewritten`` is true, the text is no longer told (null) and the piece ends where the
    outputs part. Two probes in place of a turn's text tell where in its piece the text stands; it is null where the
    template adapts what surrounds it to the text.

    A conversation is one stream of its turns through one task, which holds 2 * ``block`` of them at a time: of a longer
    one the first half is handed on once the template is seen to render the others alone as it does with them. A
    template that looks further back, or rewrites, is rendered with all prefixes, and the conversation is held.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for c, role, text in zip(*[batch[k].to_pylist() for k in ("conv_id", "role", "text")], strict=True):
                if now is None or c != now.conv:
                    done = now.rows(len(now.turns)) if now else []
                    now = Conversation(template, c, block)
                elif len(now.turns) >= 2 * block:
                    done = now.handed_on()
                else:
                    done = []
                now.add(role, text)
                rows += done
                size += sum(len(r[3]) for r in done)
                if size > BATCH or len(rows) > 5000:
                    yield batch_of(rows)
                    rows, size = [], 0
        if now:
            rows += now.rows(len(now.turns))
        yield batch_of(rows)

    laid = convs.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    laid = laid.repartition(partitions(convs.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return laid.select("conv_id", "role", "text").mapInArrow(render, PIECE)


def formatted(found: DataFrame, train_on: str = "assistant") -> DataFrame:
    """One row for each conversation of ``pieces``: conv_id, text, loss (spans of the ``train_on`` texts that are told)
    and rewritten (how many turns are). A conversation's text is one value here."""
    at = F.when((F.col("role") == train_on) & F.col("text_start").isNotNull(), F.struct(F.col("text_start").alias("start"), F.col("text_end").alias("end")))
    rows = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "piece", at.alias("at")))).alias("t"), F.count_if("rewritten").alias("rewritten"))
    return rows.select("conv_id", F.array_join("t.piece", "").alias("text"), F.filter(F.col("t.at"), lambda a: a.isNotNull()).alias("loss"), "rewritten")


def digests(found: DataFrame, template: Template = BRACKETS, train_on: str = "assistant") -> DataFrame:
    """One row for each conversation of ``pieces``, read back from them as they stream by: n_turns, turns_sha256 (role
    and text of each turn with a line end each), loss_chars and loss_sha256 (texts under the loss mask as they were
    before they were formatted), formatted_chars. Nothing of a conversation is held but its digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, loss, counts, begun = None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], False
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            rows = []
            for c, nth, piece, start, a, b in zip(*[batch[k].to_pylist() for k in ("conv_id", "nth", "piece", "start", "text_start", "text_end")], strict=True):
                if nth == 0:
                    if begun:
                        rows.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                    conv, turns, loss, counts, begun = c, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], True
                role, text = template.read(piece)
                turns.update(f"{role}\n{text}\n".encode())
                if role == train_on and a is not None:
                    plain = template.plain(piece[a - start : b - start])
                    loss.update(plain.encode())
                    counts[1] += len(plain)
                counts[0] += 1
                counts[2] += len(piece)
            yield of(rows)
        if begun:
            yield of([(conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])])

    return found.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
