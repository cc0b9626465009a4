"""Best-fit packing of token sequences, by tasks first and then up a tree.

The pieces of all documents are dealt to blocks by a hash of their place in the
input, so that all blocks look alike in whatever order the table is, and a task
packs a block by best fit, largest first. Nearly full bins are final. Of the rest
each block passes on those that can still be joined; blocks meet, their bins are
items of another best fit, and so on until one block is left. What travels up the
tree is a bin's number and filling.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.llm.batches import slices, sole_cache, text_bytes
from signalsift.llm.tokens import encoder
from signalsift.session import released, staged

#: Pieces of a block, on average; a task packs a block at a time.
BLOCK_PIECES = 100_000
#: Blocks that meet in a round of the tree.
FAN_IN = 8
#: Bins over half full that a block passes on, the emptiest first; of those up to
#: half full best fit leaves one at most, which is always passed on.
PASSED = 256
_SLICE = 1 << 20


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, largest first into the fullest bin it fits; and the number of bins."""
    order = np.argsort(-sizes, kind="stable")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # a bit for each room that some bin has
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    count = 0
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        above = rooms >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            found = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            found, room = count, capacity
            count += 1
        bins[item], offsets[item] = found, capacity - room
        left = room - size
        by_room[left].append(found)
        rooms |= 1 << left
    return bins, offsets, count


def _cut(tokenizer: str, capacity: int, end_id: int):
    schema = pa.schema(
        [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("place", pa.int64())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of each text; ``place`` is the task and a running number."""
        sole_cache("tokens", encoder.cache_clear)
        encode = encoder(tokenizer).encode
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("id").to_pylist()
            data, places = text_bytes(batch.column("text"))
            for first, stop in slices(places, _SLICE):
                texts = [data[places[i] : places[i + 1]].tobytes() for i in range(first, stop)]
                held: list[tuple] = []
                for name, found in zip(ids[first:stop], encode(texts)):
                    whole = np.append(found, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        held.append((name, piece, start, len(part), zlib.crc32(part.tobytes()), place))
                        place += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return cut


def _local(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def pack(pieces: pa.Table) -> pa.Table:
        """A block's pieces with their offsets and bins; of equal pieces the first in the input goes first."""
        pieces = pieces.sort_by("place")
        bins, offsets, _ = best_fit(pieces["length"].to_numpy(), capacity)
        bins += pieces["block"][0].as_py() << 18
        return pieces.drop_columns("place").append_column("offset", pa.array(offsets)).append_column("bin", pa.array(bins))

    return pack


def _merged(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(bins: pd.DataFrame) -> pd.DataFrame:
        """Bins as items: where each one goes, and how full the new bins are."""
        bins = bins.sort_values("bin", ignore_index=True)
        place, offset, count = best_fit(bins["filled"].to_numpy(), capacity)
        names = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(names, place, bins["bin"].to_numpy())
        filled = np.bincount(place, bins["filled"], count).astype(np.int64)
        return pd.DataFrame(
            {"block": bins["block"], "bin": bins["bin"], "into": names[place], "shift": offset, "filled": filled[place]}
        )

    return merge


def _passed_on(bins: DataFrame, capacity: int) -> DataFrame:
    """Per block: bins up to half full, and the emptiest of the rest."""
    least = F.struct("filled", "bin")
    rest = F.slice(F.array_sort(F.collect_list(F.when(F.col("filled") * 2 > capacity, least))), 1, PASSED)
    half = F.collect_list(F.when(F.col("filled") * 2 <= capacity, least))
    open_ = bins.where(F.col("filled") < capacity).groupBy("block").agg(F.concat(half, rest).alias("open"))
    return open_.select("block", F.inline("open"))


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is the tokenizer's ids of its text (null: empty) and ``end_id``;
    only longer ones are cut, into pieces of ``capacity``. An empty text is a
    piece of one id, repeated rows are packed each, an empty table gives no rows.
    Other columns are not looked at. Which of several pieces of one length goes
    where is settled by their order in the input.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long"
    cut = staged(rows.mapInArrow(_cut(tokenizer, capacity, end_id), f"{schema}, place long"), "cut")
    blocks = max(1, -(-cut.count() // BLOCK_PIECES))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
    pieces = staged(dealt.groupBy("block").applyInArrow(_local(capacity), f"{schema}, block long, offset long, bin long"), "pieces")
    released(cut)
    bins = pieces.groupBy("block", "bin").agg(F.sum("length").alias("filled"))
    open_ = _passed_on(bins, capacity)
    moves: DataFrame | None = None
    shape = "block long, bin long, into long, shift long, filled long"
    level = 0
    while blocks > 1:
        level += 1
        met = open_.withColumn("block", F.pmod(F.hash("block"), F.lit(-(-blocks // FAN_IN))).cast("long"))
        moved = staged(met.groupBy("block").applyInPandas(_merged(capacity), shape), f"bins-{level}")
        if moves is None:
            moves = moved.select("bin", F.col("into").alias("now"), "shift")
        else:
            step = moved.select(F.col("bin").alias("now"), "into", F.col("shift").alias("more"))
            moves = moves.join(step, "now", "left").select(
                "bin", F.coalesce("into", "now").alias("now"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        grown = moved.select("block", F.col("into").alias("bin"), "filled").distinct()
        open_ = _passed_on(grown, capacity)
        blocks = -(-blocks // FAN_IN)
    if moves is not None:
        moves = staged(moves.where("bin <> now or shift <> 0"), "moves")
        pieces = pieces.join(moves, "bin", "left")
        pieces = pieces.withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
        pieces = pieces.withColumn("bin", F.coalesce("now", "bin"))
    return pieces.select(
        F.col("id").alias(doc_id), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )


def op3_best_fit_packing(spark, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))
