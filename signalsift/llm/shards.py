"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts stay together. The differencing runs in two levels:
tasks join their groups into bundles of nearly equal size, and the few bundles
and the few large groups are differenced into shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalsift.session import staged

#: Groups differenced at once in a task.
BLOCK_GROUPS = 100_000
#: Bundles a shard is made of, about; a group larger than a bundle is differenced by itself.
BUNDLES_PER_SHARD = 64
#: Single groups kept beside the bundles, as small change for the last differences.
CHANGE = 2048
#: Rows numbered together.
NUMBERED = 4096


def differenced(sizes: list[int], ways: int) -> list[list[int]]:
    """Positions of ``sizes`` in ``ways`` parts of nearly equal sums.

    A partial partition is its loads in falling order (zeros left out), each
    with a tree of positions. The two with the largest spread are combined, the
    largest load of one with the smallest of the other. Ties go by order of entry.
    """
    heap = [(-size, n, [(size, n)]) for n, size in enumerate(sizes)]
    if ways == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    entry = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = ways - len(b)
        if len(a) <= free:
            loads = a + b
        else:
            loads = a[:free]
            loads += [(x + y, (p, q)) for (x, p), (y, q) in zip(a[free:], reversed(b))]
            loads += b[: ways - len(a)]
        loads.sort(key=lambda part: -part[0])
        low = loads[-1][0] if len(loads) == ways else 0
        heapq.heappush(heap, (low - loads[0][0], entry, loads))
        entry += 1
    parts: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        found, open_ = [], [tree]
        while open_:
            node = open_.pop()
            if isinstance(node, tuple):
                open_ += node
            else:
                found.append(node)
        parts.append(sorted(found))
    return parts + [[] for _ in range(ways - len(parts))]


def _bundler(bundle_bytes: float, change: int):
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        keys: list[bytes] = []
        sizes: list[int] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            order = sorted(range(len(keys)), key=lambda i: (-sizes[i], keys[i]))
            single = set(order[:: max(1, len(order) // change)][:change]) if change else set()
            rest = [i for i in order if i not in single]
            ways = max(1, round(sum(sizes[i] for i in rest) / bundle_bytes))
            parts = [[i] for i in sorted(single)] + [[rest[i] for i in p] for p in differenced([sizes[i] for i in rest], ways)]
            at = [0] * len(keys)
            for part in parts:
                for i in part:
                    at[i] = (task << 32) + number
                number += 1
            return pa.RecordBatch.from_pydict(
                {"key": pa.array(keys, pa.binary()), "bytes": pa.array(sizes, pa.int64()), "bundle": pa.array(at, pa.int64())}
            )

        for batch in batches:
            keys += batch.column("key").to_pylist()
            sizes += batch.column("bytes").to_pylist()
            while len(keys) >= BLOCK_GROUPS:
                more, more_sizes = keys[BLOCK_GROUPS:], sizes[BLOCK_GROUPS:]
                del keys[BLOCK_GROUPS:], sizes[BLOCK_GROUPS:]
                yield block()
                keys, sizes = more, more_sizes
        if keys:
            yield block()

    return bundle


def sharded(docs: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``; clashing columns are replaced.

    Size is the UTF-8 bytes of the text plus 1; a null text counts as empty and
    is grouped with the empty ones. Shards have nearly equal sums of sizes as far
    as groups of equal texts allow: a group larger than a fair share has a shard
    to itself. Slots count from 0 without gaps in each shard. An empty table
    gives an empty result; repeated rows keep their number.

    Rows travel by a 16-byte digest of their text. The driver sees the large
    groups (at most two per bundle) and one row per bundle.
    """
    kept = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot") and c != text]
    texts = F.coalesce(F.col(text), F.lit(""))
    rows = staged(
        docs.select(
            *[F.col(c).alias(f"kept_{c}") for c in kept],
            (F.octet_length(texts).cast("long") + 1).alias("size"),
            F.crc32(texts).alias("text_crc32"),
            F.unhex(F.md5(texts)).alias("key"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "shard-rows",
    )
    groups = staged(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
    total_bytes, total_rows, total_groups = (int(x or 0) for x in total)
    bundles = shards * BUNDLES_PER_SHARD
    # Large in bytes or in rows: at most two per bundle, so this list has a bound.
    large = (F.col("bytes") > total_bytes / bundles) | (F.col("n") > total_rows / bundles) if total_groups > bundles else F.lit(True)
    heavy = [(bytes(r["key"]), r["bytes"]) for r in groups.where(large).select("key", "bytes").collect()]
    blocks = max(len(groups.inputFiles()), total_groups // BLOCK_GROUPS + 1)
    bundled = staged(
        groups.where(~large)
        .select("key", "bytes")
        .mapInArrow(_bundler(max(1.0, total_bytes / bundles), CHANGE // blocks), "key binary, bytes long, bundle long"),
        "shard-bundles",
    )
    items = [(None, r["bundle"], r["bytes"]) for r in bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()]
    items = sorted(items, key=lambda i: i[1]) + [(key, None, size) for key, size in sorted(heavy)]
    spark = docs.sparkSession
    parts = differenced([i[2] for i in items], shards)
    of_bundle = [(items[i][1], shard) for shard, part in enumerate(parts) for i in part if items[i][0] is None]
    of_key = [(items[i][0], shard) for shard, part in enumerate(parts) for i in part if items[i][0] is not None]
    of_key = F.broadcast(spark.createDataFrame(of_key, "key binary, shard int"))
    of_bundle = F.broadcast(spark.createDataFrame(of_bundle, "bundle long, shard int"))
    light = bundled.join(of_bundle, "bundle").select("key", "shard")
    placed = rows.join(of_key, "key").unionByName(rows.join(of_key, "key", "left_anti").join(light, "key"))
    placed = placed.drop("key").withColumn("task", F.shiftright("at", 33))
    placed = placed.withColumn("block", F.expr(f"(at & ((1L << 33) - 1)) div {NUMBERED}"))
    placed = staged(placed, "shard-placed")
    counts = placed.groupBy("shard", "task", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "task", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("task", "block", "shard").orderBy("at")
    numbered = placed.repartition("task", "block").withColumn("nth", F.row_number().over(inside))
    out = numbered.join(starts, ["shard", "task", "block"])
    return out.select(
        *[F.col(f"kept_{c}").alias(c) for c in kept],
        "size",
        "text_crc32",
        "shard",
        (F.col("start") + F.col("nth") - 1).alias("slot"),
    )


def op9_sharding(spark, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
