r"""Chat formatting by columnar byte assembly.

Template of a turn: ``### role: text </turn>`` and a line feed. In a text, a
backslash, a turn header's ``### `` and ``</turn>`` get a backslash before them;
in a role also ``:``. So an unescaped ``</turn>`` ends a turn, an unescaped ``:``
a role, and taking one backslash away gives back every text.

For a batch of turns the lengths of the segments (header, role, separator,
text, end) are known at once; their running sums are the places in the output,
and all bytes are moved by one indexed copy into the buffer of an Arrow array.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.llm.batches import changes, slices, text_bytes

HEADER, SEPARATOR, END = b"### ", b": ", b" </turn>\n"
#: Bytes assembled at once.
SLICE_BYTES = 2 << 20

PARTS = "conv_id long, first_turn long, first_place long, n_turns int, formatted string, loss array<struct<start:long,stop:long>>"


def escaped(column: pa.Array, role: bool = False) -> pa.Array:
    for mark in ("\\", "### ", "</turn>", *([":"] if role else [])):
        column = pc.replace_substring(column, mark, "\\" + mark)
    return column


_ESCAPE = re.compile(r"\\(\\|### |</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn begins (and the end), and where each text begins and ends."""
    role_bytes, role_at = text_bytes(escaped(roles, role=True))
    body_bytes, body_at = text_bytes(escaped(texts))
    n = len(roles)
    fixed = np.frombuffer(HEADER + SEPARATOR + END, np.uint8)
    source = np.concatenate([fixed, role_bytes, body_bytes])
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(HEADER), len(SEPARATOR), len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(body_at)
    begins = np.empty((n, 5), np.int64)
    begins[:, 0], begins[:, 2], begins[:, 4] = 0, len(HEADER), len(HEADER) + len(SEPARATOR)
    begins[:, 1] = len(fixed) + role_at[:-1]
    begins[:, 3] = len(fixed) + len(role_bytes) + body_at[:-1]
    ends = np.cumsum(lengths.ravel())
    places = ends - lengths.ravel()
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    if n:
        np.take(source, np.repeat(begins.ravel() - places, lengths.ravel()) + np.arange(ends[-1]), out=out)
    places = places.reshape(n, 5)
    return out, np.append(places[:, 0], len(out)), places[:, 3], places[:, 3] + lengths[:, 3]


def _character_counts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each byte place."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[places]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of turns of a conversation in a slice of a batch."""
    for batch in batches:
        table = pa.table(batch.columns, batch.schema.names)
        sizes = sum(np.diff(text_bytes(batch.column(c))[1]) for c in ("role", "text"))
        for start, stop in slices(np.concatenate([[0], np.cumsum(sizes)]), SLICE_BYTES):
            part = table.slice(start, stop - start).combine_chunks()
            columns = {c: part.column(c).combine_chunks() for c in part.column_names}
            roles = pc.fill_null(columns["role"], "")
            data, turns, text_start, text_stop = assembled(roles, pc.fill_null(columns["text"], ""))
            cuts = changes(part, ["conv_id"])
            first, last = cuts[:-1], cuts[1:]
            offsets = turns[cuts]
            formatted = pa.Array.from_buffers(
                pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
            )
            learned = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
            own = np.repeat(offsets[:-1], last - first)
            base = _character_counts(data, own)
            spans = pa.StructArray.from_arrays(
                [
                    pa.array((_character_counts(data, text_start) - base)[learned]),
                    pa.array((_character_counts(data, text_stop) - base)[learned]),
                ],
                names=["start", "stop"],
            )
            counted = np.concatenate([[0], np.cumsum(learned)])[cuts]
            loss = pa.ListArray.from_arrays(pa.array(counted.astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays(
                [
                    columns["conv_id"].take(pa.array(first)),
                    columns["turn"].take(pa.array(first)),
                    columns["place"].take(pa.array(first)),
                    pa.array((last - first).astype(np.int32)),
                    formatted,
                    loss,
                ],
                names=["conv_id", "first_turn", "first_place", "n_turns", "formatted", "loss"],
            )


def formatted(turns: DataFrame) -> DataFrame:
    """Formatted conversations with their loss mask, from ``conv_id, turn, role, text``.

    Rows ``conv_id, first_turn, first_place, n_turns, formatted, loss``: as a rule one for a
    conversation; where one is cut by a task's or batch's bounds its parts follow each other
    in the order of ``first_turn, first_place``. ``loss`` has the spans, in code points of ``formatted``, of the
    (escaped) assistant texts, whose loss counts.

    Turns are dealt out by ranges of ``(conv_id, turn)``, so that a conversation
    of any length is spread over tasks and never held as a whole. Turns
    go in the order of turn, role, text (nulls first); a null role or text is an
    empty one, repeated rows are repeated turns, a null ``conv_id`` is a
    conversation of its own, other columns are left out, no rows give no rows.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    spread = rows.repartitionByRange("conv_id", "turn", F.xxhash64("role", "text")).sortWithinPartitions(*order)
    spread = spread.withColumn("place", F.monotonically_increasing_id())
    return spread.mapInArrow(_format, PARTS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of sorted conversations to their figures; only the digests are carried on."""
    key: object = ()
    state: list = []
    done: list[tuple] = []

    def close() -> None:
        if state:
            n, turns, chars, loss, total = state
            done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    for batch in batches:
        for row in batch.to_pylist():
            if not state or row["conv_id"] != key:
                close()
                key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text, at, found = row["formatted"], 0, 0
            while at < len(text):
                turn = _TURN.match(text, at)
                state[1].update(f"{unescaped(turn[1])}\n{unescaped(turn[2])}\n".encode())
                at, found = turn.end(), found + 1
            state[0] += found
            for span in row["loss"]:
                learned = unescaped(text[span["start"] : span["stop"]])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(text)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in done], schema=_SCHEMA)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in done], schema=_SCHEMA)


_NAMES = [c.split()[0] for c in READ.split(", ")]
_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in READ.split(", ")])


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, what the formatted parts say: turns, digests, loss, length."""
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "first_place")
    return ordered.mapInArrow(_read, READ)


def op2_chat_formatting(spark, folder: str) -> DataFrame:
    r"""All conversations and one whose texts are control strings, formatted and read back."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(turns.unionByName(extra)))
