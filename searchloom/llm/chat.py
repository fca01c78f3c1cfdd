"""Chat formatting: a finite-state machine over roles and a declarative template turn conversations into segments.

Rows are dealt by conversation and sorted by turn; a task then streams them, so a conversation of any length needs
the memory of one turn. Each output row is one segment: text, whether the loss covers it, and whether every turn
so far came in an order that the template's machine allows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """marks: role -> (text before a turn, text after it); loss: roles whose texts are trained on.

    moves: state -> roles that may follow; the state is the last role, "" at the start; final: states that may end.
    Roles without marks use `other`, with the escaped role name in place of {role}. Each opening mark must begin
    with a control string, and no two may begin alike. Texts never hold an unescaped control string.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<s>[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANSWER] ", " [/ANSWER]</s>")})
    other: tuple[str, str] = ("[ROLE {role}] ", " [/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANSWER]", "[/ANSWER]", "[ROLE", "[/ROLE]")
    escape: str = "\x1b"

    def escaped(self, text: str) -> str:
        """text with its escape characters doubled and one put behind the first character of each control string."""
        text = text.replace(self.escape, self.escape * 2)
        return re.sub("|".join(map(re.escape, self.controls)), lambda m: m[0][0] + self.escape + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text)

    def around(self, role: str) -> tuple[str, str]:
        if role in self.marks:
            return self.marks[role]
        return self.other[0].replace("{role}", self.escaped(role).replace("]", self.escape + "]")), self.other[1]

    def opening(self, text: str) -> tuple[str, int] | None:
        """The role that the mark at the start of formatted text opens, and the mark's length; None if none stands there."""
        for role, (before, _) in self.marks.items():
            if text.startswith(before):
                return role, len(before)
        head, tail = self.other[0].split("{role}")
        e, end = re.escape(self.escape), re.escape(tail[0])
        found = re.match(f"{re.escape(head)}((?:[^{e}{end}]|{e}.)*){re.escape(tail)}", text, re.S)
        return (self.unescaped(found[1]), found.end()) if found else None


def format_chats(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per segment: (conv, turn_no, part, segment, loss, valid, may_end), in order within partitions.

    Each turn gives three segments: opening mark (part 0), escaped text (1), closing mark (2). turn_no counts from 0.
    Turns go by `turn`, ties by role and text, nulls first; a null role or text is empty, repeated rows are turns of
    their own, and rows with a null conversation make one conversation. Conversations that break the order are
    formatted all the same, with valid false from the first breach on. Other columns are ignored.
    """
    template = template or Template()
    schema = T.StructType([T.StructField(conv, turns.schema[conv].dataType), T.StructField("turn_no", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("segment", T.StringType()), T.StructField("loss", T.BooleanType()), T.StructField("valid", T.BooleanType()), T.StructField("may_end", T.BooleanType())])

    def emit(batches):
        now, state, valid, n = object(), "", True, 0
        for batch in batches:
            rows = [], [], [], [], [], []
            take = []
            for i, (c, r, t) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if c != now:
                    now, state, valid, n = c, "", True, 0
                r, t = r or "", t or ""
                valid = valid and r in template.moves.get(state, ())
                state = r
                before, after = template.around(r)
                for part, segment in enumerate((before, template.escaped(t), after)):
                    take.append(i)
                    for column, value in zip(rows, (n, part, segment, part == 1 and r in template.loss, valid, valid and r in template.final), strict=True):
                        column.append(value)
                n += 1
            kinds = pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()
            yield pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], schema.names)

    dealt = turns.select(conv, turn, role, text).repartition(conv).sortWithinPartitions(conv, turn, role, text)
    return dealt.select(conv, role, text).mapInArrow(emit, schema)


def read_back(segments: DataFrame, template: Template | None = None, conv: str = "conv_id") -> DataFrame:
    """Per conversation, what its segments say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.

    segments: as format_chats() gives them, in its order, or the same text cut elsewhere. Their joined text is scanned
    for marks, and roles, texts and what the loss covers come from that alone; texts are unescaped. Text in which no
    turn opens or closes counts as one more turn of no role. `valid` is the segments' own.
    """
    template = template or Template()
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    schema = T.StructType([T.StructField(conv, segments.schema[conv].dataType), *(T.StructField(n, T.StringType() if "sha" in n else T.BooleanType() if n == "valid" else T.LongType()) for n in names[1:])])

    def parse(batches):
        now, held = object(), None

        def out(rows):
            kinds = segments_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        def turn(h, role, said):
            h["turns"].update(f"{role}\n{said}\n".encode())
            h["n"] += 1
            if role in template.loss:
                h["loss"].update(said.encode())
                h["loss_chars"] += len(said)

        def scan(h, segment):
            """Takes the turns that end in what is held and the segment, and holds the rest."""
            seen, h["text"] = len(h["text"]), h["text"] + segment
            while True:
                if h["role"] is None:
                    if not (mark := template.opening(h["text"])):
                        return
                    h["role"], seen, h["text"] = mark[0], 0, h["text"][mark[1] :]
                after = template.around(h["role"])[1]
                if (at := h["text"].find(after, max(0, seen - len(after)))) < 0:
                    return
                turn(h, h["role"], template.unescaped(h["text"][:at]))
                h["role"], seen, h["text"] = None, 0, h["text"][at + len(after) :]

        def closed(h):
            if h["text"] or h["role"] is not None:
                turn(h, None, h["text"])
            return now, h["n"], h["turns"].hexdigest(), h["loss_chars"], h["loss"].hexdigest(), h["chars"], h["valid"] and h["end"]

        for batch in batches:
            segments_kind, rows = batch.schema.field(0).type, []
            for c, segment, valid, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held is None or c != now:
                    if held:
                        rows.append(closed(held))
                    now, held = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "role": None, "text": "", "valid": True}
                held["chars"] += len(segment)
                held["valid"], held["end"] = valid, end
                scan(held, segment)
            if rows:
                yield out(rows)
        if held:
            yield out([closed(held)])

    return segments.select(conv, "segment", "valid", "may_end").mapInArrow(parse, schema)
