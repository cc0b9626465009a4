"""Near-duplicate vectors by random-hyperplane sign hashing.

Equal vectors are one class first. Each class gets a bucket in every table (the
signs against random planes); classes of a bucket are compared exactly, by
products of blocks of vectors in double precision. A task gives back, for each
class, the number of its links that no earlier table has found, and a forest of
the links, so the pairs of a large group never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.llm.batches import runs
from signalsift.llm.components import components
from signalsift.session import staged

#: Largest block of a bucket; larger buckets are cut into blocks that are compared pairwise.
BLOCK = 512
#: Chance that a pair right at the threshold meets in some table.
RECALL = 0.999
_SEED = 20_240_607


def tables_for(classes: int, threshold: float) -> tuple[int, int]:
    """Bits per table and number of tables: half-full blocks on average, and the wanted recall."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(1, math.ceil(math.log2(max(2.0, 2 * classes / BLOCK)))))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))


def _matrix(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors in double precision, for each number of dimensions."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = []
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        x = values[starts[rows][:, None] + np.arange(size)]
        x /= np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]))
    return out


def _signer(bits: int, tables: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            signs = np.zeros((batch.num_rows, tables), np.int32)
            for rows, x in _matrix(batch.column("vector")):
                planes = np.random.default_rng([_SEED, x.shape[1]]).standard_normal((tables * bits, x.shape[1]))
                above = (x @ planes.T > 0).reshape(len(rows), tables, bits)
                signs[rows] = above @ weights
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(signs.ravel()))], names=[*batch.schema.names, "signs"]
            )

    return sign


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _comparer(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches, ["table", "size", "sign", "low", "high"]):
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            # Blocks hold vectors of one size; where all rows do, they are read at once.
            parts = _matrix(columns["vector"])
            units = parts[0][1] if len(parts) == 1 else None
            reps, mult, place, own = (columns[c].to_numpy(zero_copy_only=False) for c in ("rep", "mult", "table", "block"))
            low, high = (columns[c].to_numpy(zero_copy_only=False) for c in ("low", "high"))
            signs = columns["signs"].flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for start, stop in zip(cuts[:-1], cuts[1:]):
                x = units[start:stop] if units is not None else _matrix(columns["vector"][start:stop])[0][1]
                if low[start] == high[start]:
                    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                else:
                    left, right = (np.flatnonzero(own[start:stop] == b) for b in (low[start], high[start]))
                    i, j = np.nonzero(x[left] @ x[right].T >= threshold)
                    i, j = left[i], right[j]
                if not len(i):
                    continue
                i, j = i + start, j + start
                n = stop - start
                label = _smallest(n, i - start, j - start) + start
                moved = np.flatnonzero(label != np.arange(start, stop)) + start
                found.append((reps[moved], reps[label[moved - start]], np.zeros(len(moved), np.int64)))
                t = int(place[start])
                new = np.ones(len(i), bool)
                for earlier in range(t):
                    new &= signs[i, earlier] != signs[j, earlier]
                counts = np.bincount(i[new] - start, mult[j[new]], n) + np.bincount(j[new] - start, mult[i[new]], n)
                some = np.flatnonzero(counts)
                found.append((reps[some + start], reps[some + start], counts[some].astype(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=schema)

    return compare


def linked(df: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row of ``df``: ``vec_id, n_links, component_id, kept``.

    Links join vectors of the same number of dimensions whose cosine is at least
    ``threshold``; copies are links too. A vector that is null, empty or zero, or
    holds a null or non-finite component, and a row without an id link with
    nothing. A vector without links is its own component. Every row comes back,
    repeats included; other columns are left out; no rows give no rows.

    A pair of exactly the threshold is found with probability ``RECALL``, a
    closer one more often, a farther one never.
    """
    kept = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
    infinite = [float("inf"), float("-inf")]
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | v.isin(infinite))
    good = F.col("id").isNotNull() & F.coalesce(F.exists("vector", lambda v: v != 0) & ~odd, F.lit(False))
    rows = staged(kept.withColumn("vector", F.when(good, F.col("vector"))), "vectors")
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    classes = staged(classes, "vector-classes")
    bits, tables = tables_for(classes.count(), threshold)
    shape = f"{classes.schema.simpleString()[7:-1]},signs:array<int>"
    signed = classes.mapInArrow(_signer(bits, tables), shape)
    signed = staged(signed, "vector-signs")
    buckets = signed.select("rep", F.size("vector").alias("size"), F.posexplode("signs").alias("table", "sign"))
    key = ["size", "table", "sign"]
    large = buckets.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = large.select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    spread = signed.select("*", F.size("vector").alias("size"), F.posexplode("signs").alias("table", "sign")).join(large, key, "left")
    spread = spread.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.hash("rep"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    met = ["table", "size", "sign", "low", "high"]
    spread = spread.select(*met, "block", "rep", "mult", "vector", "signs")
    spread = spread.repartition(*met).sortWithinPartitions(*met)
    found = staged(spread.mapInArrow(_comparer(threshold), "a long, b long, n long"), "vector-links")
    links = found.where("a <> b").select("a", "b")
    counts = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(links).select(F.col("node").alias("rep"), "component")
    told = classes.join(counts, "rep", "left").join(groups, "rep", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("component")
    )
    out = rows.join(told, "vector", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(vec_id),
        F.coalesce("n", F.lit(0)).alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op5_embedding_near_dedup(spark, folder: str) -> DataFrame:
    """All embeddings linked by a cosine of 0.95 and more."""
    return linked(spark.read.parquet(f"{folder}/embeddings.parquet"))
