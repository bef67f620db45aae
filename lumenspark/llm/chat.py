"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are the context, and only
that reply is trainable. Turns after the last assistant turn (or all, if there is none) form a
closing example without a trainable part, so no turn is lost.

A turn is written ``<s>[INST] role [SEP] text [/INST]</s>`` with the control strings in CONTROLS.
Inside roles and texts a backslash is doubled, and each control string gets a backslash after its
first character, so an escaped text holds no control string and unescaping gives back the text.

Edge cases: null texts and roles are read as empty; rows go by turn (null first), then role and
text where turns tie, and repeated rows stay; an empty table gives an empty table; a null
conversation id is a conversation of its own; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BEGIN, SEP, END = "<s>[INST]", "[SEP]", "[/INST]</s>"
#: Strings that may steer a model; none of them can appear inside an escaped text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SEP]")
_BREAK = re.compile("([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
_TURN = re.compile(re.escape(BEGIN) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _BREAK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The written turn, and where its text begins and ends in it."""
    head = f"{BEGIN}{escape(role or '')}{SEP}"
    body = escape(text or "")
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]] | None]]:
    """(conversation, its next rows) in order; (conversation, None) closes it."""
    last: object = ()
    for batch in batches:
        ids, roles, texts = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            if last != (ids[at],):
                if last:
                    yield last[0], None
                last = (ids[at],)
            yield ids[at], list(zip(roles[at:end], texts[at:end], strict=True))
            at = end
    if last:
        yield last[0], None


def _sorted(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("_c"), F.col(turn_col).alias("_t"), F.col(role_col).alias("_r"), F.col(text_col).alias("_x"))
    return rows.repartition("_c").sortWithinPartitions("_c", "_t", "_r", "_x").select("_c", "_r", "_x")


def examples(turns: Iterable[tuple[str | None, str | None] | None], trainable: str = "assistant") -> Iterator[tuple[str, int, int] | None]:
    """(text, loss_start, loss_end) of every example of conversations whose turns (role, text) come in order; null ends one, in and out.

    A text grows in place from one example to the next, as long as nobody keeps the one before.
    """
    text, open_ = "", False
    for turn in turns:
        if turn is None:
            if open_:
                yield text, -1, -1
            yield None
            text, open_ = "", False
            continue
        made, a, b = format_turn(*turn)
        start = len(text)
        text += made
        open_ = turn[0] != trainable
        if not open_:
            yield text, start + a, start + b


def _examples(batches: Iterator[pa.RecordBatch], trainable: str) -> Iterator[tuple[object, tuple[str, int, int] | None]]:
    """(conversation, its next example) in order; (conversation, null) closes it."""
    now: list = []

    def turns():
        for conv, rows in _conversations(batches):
            now[:] = [conv]
            yield from [None] if rows is None else rows

    for example in examples(turns(), trainable):
        yield now[0], example
        example = None  # so that the text can grow in place


def expand(df: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", trainable="assistant") -> DataFrame:
    """One row per example: id, example (from 0), text, loss_start, loss_end (code points; -1 if nothing is trainable).

    Memory per task: one conversation's formatted text, as its last example has to hold all of it.
    """
    kind = df.schema[id_col].dataType

    def run(batches):
        out, size, k = [], 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), kinds, strict=True)], names=["id", "example", "text", "loss_start", "loss_end"])

        for conv, example in _examples(batches, trainable):
            if example is None:
                k = 0
                continue
            out.append((conv, k, *example))
            size += len(example[0])
            k += 1
            if size > 1 << 22:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    out = _sorted(df, id_col, turn_col, role_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, example long, text string, loss_start long, loss_end long")
    return out.withColumnRenamed("id", id_col)


class _Reader:
    """Reads the examples of one conversation back.

    Every example repeats the one before it, which is compared by length and end, and parsed for what
    it adds; its mask is cut from the example's own text.
    """

    def __init__(self):
        self.n, self.loss, self.total, self.seen, self.end = 0, 0, 0, 0, ""
        self.turns, self.hash = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, start: int, end: int) -> None:
        if text[max(0, self.seen - len(self.end)) : self.seen] != self.end:
            raise ValueError("an example does not begin with the one before it")
        for role, said in parse(text[self.seen :]):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        self.total += len(text)
        self.seen, self.end = len(text), text[-len(END) :]
        if start >= 0:
            trained = unescape(text[start:end])
            self.loss += len(trained)
            self.hash.update(trained.encode("utf-8", "surrogatepass"))

    def row(self):
        return self.n, self.turns.hexdigest(), self.loss, self.hash.hexdigest(), self.total


def digest(df: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", trainable="assistant") -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The examples are those of `expand`, made one after the other in the task that reads them and not
    kept; formatted_chars counts all characters of all of them. Memory: one conversation's formatted text.
    """
    kind = df.schema[id_col].dataType

    def run(batches):
        out, reader = [], _Reader()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), kinds, strict=True)], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, example in _examples(batches, trainable):
            if example is not None:
                reader.read(*example)
                example = None  # so that the text can grow in place
                continue
            out.append((conv, *reader.row()))
            reader = _Reader()
            if len(out) >= 5000:
                yield flush()
                out = []
        if out:
            yield flush()

    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = f"id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _sorted(df, id_col, turn_col, role_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_probe(conversations: DataFrame) -> DataFrame:
    """All conversations plus number -1, whose two rows say the template's own control strings."""
    probe = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
