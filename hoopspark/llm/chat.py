"""Chat formatting by a grammar round trip.

    conversation := turn*
    turn := "[INST] " body " [/INST]" | "<s> " body " </s>" | "<<SYS>> " body " <</SYS>>" | "[ROLE]" name "[/ROLE] " body " [/TURN]"

for user, assistant, system and any other role. A rendered turn is parsed again; while the parser does not give back the
turn, control strings in it are escaped one step further: a backslash goes behind their first character, and one more
behind those that stand there already, so that removing one restores the text.

Null text is empty and a null role is the empty role; turns of one conversation go by turn (null first), then role and
text, so repeated rows and ties have one order; a null conversation id is a conversation; other columns are ignored. An
empty table gives no rows. A conversation is never held whole: its turns are rendered and parsed row by row, and digests
read the ordered stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
NAMED, NAMED_END, OTHER_END = "[ROLE]", "[/ROLE]", "[/TURN]"
LOSS_ROLE = "assistant"

_TAIL = r"(?=/?s>|/?INST\]|</?SYS>>|/?ROLE\]|/TURN\])"
_CONTROL = re.compile(r"[<\[]" + _TAIL)
_STUFF = re.compile(r"([<\[]\\*)" + _TAIL)
_UNSTUFF = re.compile(r"([<\[]\\*)\\" + _TAIL)
SEGMENTS = "conv_id {id}, turn {turn}, segment string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _STUFF.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNSTUFF.sub(r"\1", text)


def render(role: str, body: str) -> tuple[str, int]:
    """A turn's string and where its body begins."""
    if role in MARKS:
        head, tail = MARKS[role][0] + " ", " " + MARKS[role][1]
    else:
        head, tail = f"{NAMED}{escape(role)}{NAMED_END} ", " " + OTHER_END
    return head + body + tail, len(head)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start of body, end of body) of each turn; ValueError for a string outside the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        role = next((r for r, (head, _) in MARKS.items() if formatted.startswith(head + " ", at)), None)
        if role is not None:
            start, tail = at + len(MARKS[role][0]) + 1, MARKS[role][1]
        elif formatted.startswith(NAMED, at):
            named = _CONTROL.search(formatted, at + len(NAMED))
            if not named or not formatted.startswith(NAMED_END + " ", named.start()):
                raise ValueError(f"no role name at {at}")
            role, start, tail = unescape(formatted[at + len(NAMED):named.start()]), named.start() + len(NAMED_END) + 1, OTHER_END
        else:
            raise ValueError(f"no turn begins at {at}")
        closing = _CONTROL.search(formatted, start)
        if not closing or not formatted.startswith(tail, closing.start()) or closing.start() <= start or formatted[closing.start() - 1] != " ":
            raise ValueError(f"the turn at {at} does not end")
        end = closing.start() - 1
        turns.append((role, unescape(formatted[start:end]), start, end))
        at = closing.start() + len(tail)
    return turns


def round_trip(role: str, text: str) -> tuple[str, int, int]:
    """The turn's string that parses back to the turn, and its body's place."""
    body = text
    while True:
        segment, start = render(role, body)
        try:
            same = [t[:2] for t in parse(segment)] == [(role, text)]
        except ValueError:
            same = False
        if same:
            return segment, start, start + len(body)
        if (further := escape(body)) == body:
            raise ValueError("a turn without control strings did not parse back")
        body = further


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(round_trip(r, t), r) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([x[0] for x, _ in out], pa.string()),
            pa.array([x[1] if r == LOSS_ROLE else None for x, r in out], pa.int32()),
            pa.array([x[2] if r == LOSS_ROLE else None for x, r in out], pa.int32())],
            names=["conv_id", "turn", "segment", "loss_start", "loss_end"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, segment, and the code points of the segment under the loss mask. The formatted
    conversation is its segments one after another, by turn, then role and text as recovered."""
    types = dict(conversations.dtypes)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_segments, SEGMENTS.format(id=types["conv_id"], turn=types["turn"]))


RECOVERED = "conv_id {id}, turn {turn}, role string, text string, loss_text string, formatted_chars int"


def _recovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts, losses, sizes = [], [], [], []
        for segment, start, end in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            (role, text, _, _), = parse(segment)
            roles.append(role)
            texts.append(text)
            losses.append(None if start is None else unescape(segment[start:end]))
            sizes.append(len(segment))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()),
                                          pa.array(losses, pa.string()), pa.array(sizes, pa.int32())],
                                         names=["conv_id", "turn", "role", "text", "loss_text", "formatted_chars"])


def read_turns(segments: DataFrame) -> DataFrame:
    """Turns parsed back from the formatted output."""
    types = dict(segments.dtypes)
    return segments.mapInArrow(_recovered, RECOVERED.format(id=types["conv_id"], turn=types["turn"]))


DIGESTS = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state, kind = None, None

    def row():
        conv, n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, role, text, loss, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(row())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[3] += len(loss)
                state[4].update(loss.encode())
            state[5] += size
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _types(kind))], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), _types(kind))], names=names)


def _types(kind: pa.DataType) -> list[pa.DataType]:
    return [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation. A digest needs the turns in order, so each conversation is one sorted stream; it is read
    through, never gathered."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_digests, DIGESTS.format(id=dict(turns.dtypes)["conv_id"]))
