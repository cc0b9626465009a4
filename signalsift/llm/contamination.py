"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are put into size classes of two. A long document is cut into overlapping
windows of a size that belongs to the class, so that a window that holds an item
is at most four times as large as it: their Jaccard similarity, and with it the
chance that their minima under a random order are the same, is bounded below
for short items in documents of any length. Documents no larger than a window are one.
What meets under one of the orders is verified by exact shingle containment.

The minima of all items go into a bit array of fixed size, which every task has; a
window's minimum goes on to the join with the items only if its bit is set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.llm.shingles import LETTERS, mixed, shingled
from signalsift.session import staged

#: Bits of the array that every task has (4 MiB).
BITS = 1 << 25
_ORDERS = np.random.default_rng(20_240_811).integers(1, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Search:
    """Shingles of ``words`` words; an item is found from ``percent`` per cent of its shingles on."""

    words: int = 5
    percent: int = 80
    #: Chance to find an item that a window holds at exactly that share.
    recall: float = 0.999

    @property
    def orders(self) -> int:
        # A window of 4 q shingles with a share t of an item of q: J >= t q / (4 q + q - t q).
        t = self.percent / 100
        return math.ceil(math.log(1 - self.recall) / math.log(1 - t / (5 - t)))

    def needed(self, size: F.Column) -> F.Column:
        return F.floor((size * self.percent + 99) / 100)


def _size_class(n: int) -> int:
    """Items of ``2**k`` to ``2**(k+1) - 1`` shingles are of class ``k``."""
    return n.bit_length() - 1


def _window(size_class: int) -> tuple[int, int]:
    """Step and length of a class's windows: any run as long as its largest item lies in one."""
    step = 1 << (size_class + 1)
    return step, 2 * step


def _slot(size_class: int, words: int, order: int, least: np.ndarray) -> np.ndarray:
    salt = np.uint64((size_class * 64 + words) * 256 + order)
    return mixed(least ^ mixed(np.array([salt], np.uint64))).view(np.int64)


def _ordered(shingles: np.ndarray, order: int) -> np.ndarray:
    """The shingles' places in a random order: an odd multiplication, a shift, another one."""
    x = shingles * (_ORDERS[2 * order] | np.uint64(1))
    x ^= x >> np.uint64(32)
    x *= _ORDERS[2 * order + 1] | np.uint64(1)
    return x


ITEM = "item long, words int, size int, class int, shingles array<long>, slots array<long>"


def _item_reader(like: Search):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes, shingles and minima of items. Items of fewer words than a shingle are one shingle of their words."""
        for batch in batches:
            column = batch.column("text")
            found: dict[int, list[np.ndarray]] = {w: [] for w in range(1, like.words + 1)}
            for words, rows in found.items():
                for _, part in shingled(column, words, LETTERS, whole=False):
                    rows += part
            out = []
            for i, item in enumerate(batch.column("item").to_pylist()):
                words = next((w for w in range(like.words, 0, -1) if len(found[w][i])), 0)
                if item is None or not words:
                    continue
                held = np.unique(found[words][i])
                of = _size_class(len(held))
                slots = [int(_slot(of, words, k, _ordered(held, k).min(keepdims=True))[0]) for k in range(like.orders)]
                out.append((item, words, len(held), of, held.view(np.int64), slots))
            names = ["item", "words", "size", "class", "shingles", "slots"]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return read


def _finder(like: Search, shared, classes: list[tuple[int, int]]):
    schema = pa.schema([("doc", pa.int64()), ("slot", pa.int64())])
    by_words: dict[int, list[int]] = {}
    for words, of in classes:
        by_words.setdefault(words, []).append(of)

    def minima(ordered: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Minimum of each window of two steps, and its document."""
        counts = np.diff(at)
        blocks = -(-counts // step)
        ends = np.cumsum(blocks)
        first = ends - blocks
        doc = np.repeat(np.arange(len(counts)), blocks)
        starts = at[doc] + (np.arange(ends[-1]) - first[doc]) * step
        low = np.minimum.reduceat(ordered, starts)
        joined = low.copy()
        more = np.flatnonzero(doc[1:] == doc[:-1])
        joined[more] = np.minimum(low[more], low[more + 1])
        # The last block of a longer document lies in the window before it.
        last = (np.arange(ends[-1]) == ends[doc] - 1) & (blocks[doc] > 1)
        return joined[~last], doc[~last]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for words, sizes in by_words.items():
                for start, rows in shingled(batch.column("text"), words, LETTERS, whole=False):
                    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                    if not at[-1]:
                        continue
                    hashes = np.concatenate(rows)
                    for k in range(like.orders):
                        ordered = _ordered(hashes, k)
                        for of in sizes:
                            low, doc = minima(ordered, at, _window(of)[0])
                            slot = _slot(of, words, k, low)
                            place = slot.view(np.uint64) & np.uint64(BITS - 1)
                            hit = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                            if len(hit):
                                pairs = np.unique(np.stack([docs[start + doc[hit]], slot[hit]]), axis=1)
                                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

    return find


def _verifier(like: Search):
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("shared", pa.int32())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many shingles of each candidate item a document has."""
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                held: dict[int, np.ndarray] = {}
                doc = one.column("doc")[0].as_py()
                for item in one.column("items")[0].as_py():
                    if item["words"] not in held:
                        (_, rows), = shingled(one.column("text"), item["words"], LETTERS, whole=False)
                        held[item["words"]] = np.unique(rows[0].view(np.int64))
                    known, wanted = held[item["words"]], np.array(item["shingles"], np.int64)
                    place = np.searchsorted(known, wanted)
                    out.append((doc, item["item"], int((known[np.minimum(place, len(known) - 1)] == wanted).sum()) if len(known) else 0))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return verify


def contained(
    docs: DataFrame, items: DataFrame, like: Search = Search(), doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, shared, size, containment`` of all items found in documents.

    Words are runs of letters and digits, lower-cased; an item is found in a
    document that has at least ``like.percent`` per cent of its different shingles.
    An item of fewer words than a shingle is one shingle of all its words. Items and
    documents without words (or null), and rows without an id, are found
    nowhere. Rows with the same document id are one document, items with the same id
    one each; a pair is told once. Other columns are left out.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.lower(text).alias("text"))
    asked = staged(asked.mapInArrow(_item_reader(like), ITEM), "items")
    classes = [tuple(r) for r in asked.select("words", "class").distinct().collect()]
    slots = asked.select("item", F.explode("slots").alias("slot"))
    # At most BITS different numbers come to the driver, however many items there are.
    places = slots.select((F.col("slot").bitwiseAND(F.lit(BITS - 1))).cast("int").alias("place")).distinct()
    bits = np.zeros(BITS, bool)
    bits[places.toArrow().column("place").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    lowered = texts.select("doc", F.lower("text").alias("text"))
    met = lowered.mapInArrow(_finder(like, shared, sorted(classes)), "doc long, slot long").distinct()
    met = staged(met.join(slots, "slot").select("doc", "item").distinct(), "met")
    of_doc = met.join(asked.select("item", "words", "size", "shingles"), "item").groupBy("doc")
    of_doc = of_doc.agg(F.collect_list(F.struct("item", "words", "shingles")).alias("items"))
    counted = lowered.join(of_doc, "doc").mapInArrow(_verifier(like), "doc long, item long, shared int")
    counted = counted.groupBy("doc", "item").agg(F.max("shared").alias("shared"))
    sizes = asked.groupBy("item").agg(F.max("size").alias("size"))
    found = counted.join(sizes, "item").where(F.col("shared") >= like.needed(F.col("size")))
    return found.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        "shared",
        "size",
        (F.col("shared") / F.col("size")).alias("containment"),
    )


def op10_benchmark_decontamination(spark, folder: str) -> DataFrame:
    """All benchmark items in all documents, by five-word shingles, from 80 per cent on."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    return contained(docs, items)
