"""Merkle manifest of a dataset by slot pivots.

A row is a leaf, the digest of its columns. The leaves of a group (a source) are
numbered in order; ``FANOUT`` consecutive nodes have one parent, and the groups'
roots have a tree of their own. A level is one grouped aggregate: conditional
aggregates spread each parent's children into a column for each slot, and the
joined columns are hashed. On the way down the same columns, without the own
slot, are the siblings of a child, so a proof needs no look-up of its own: every
parent hands its children their siblings and its own path.

Only digests travel: the texts are read once. The levels are written to the shared
checkpoint folder, and the driver sees the number of leaves of the largest group
and the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsift.session import staged

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together; digests go in as their hex text."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's columns."""
    return hashed(*map(encoded, values))


def _numbered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0 in each ``g``, in the order of ``by``) and ``n``, the size of ``g``.

    A group is cut into ranges of its order, so a large one is many tasks.
    """
    rows = staged(rows.withColumn("salt", F.monotonically_increasing_id()), "manifest-rows")
    order = ["g", *by, "salt"]
    at = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    rows = staged(rows.drop("salt").withColumn("part", F.shiftright("at", 33)), "manifest-sorted")
    counts = rows.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "g", "part", F.sum("held").over(group).alias("n"),
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    placed = rows.join(counts, ["g", "part"]).withColumn("place", F.col("at") + F.col("shift"))
    return placed.drop("at", "part", "shift")


def _slots(names: Sequence[str]) -> list[Column]:
    """For each slot, the first of ``names`` in it, as a struct."""
    item = F.struct(*names)
    return [F.first(F.when(F.col("place") % FANOUT == k, item), True).alias(f"c{k}") for k in range(FANOUT)]


def _digest(k: int) -> Column:
    return F.coalesce(F.col(f"c{k}.digest"), F.lit(""))


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pivoted levels from the leaves up, and for each height the nodes that are their groups' roots."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], []
    items = [c for c in nodes.columns if c not in ("g", "n", "place")]
    while most > 1:
        roots.append(nodes.where("n = 1"))
        parents = nodes.where("n > 1").withColumn("parent", F.expr(f"place div {FANOUT}"))
        pivot = staged(parents.groupBy("g", "n", "parent").agg(*_slots(items)), "manifest-level")
        levels.append(pivot)
        nodes = pivot.select(
            "g",
            F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
            F.col("parent").alias("place"),
            hashed(*map(_digest, range(FANOUT))).alias("digest"),
        )
        items = ["digest"]
        most = -(-most // FANOUT)
    roots.append(nodes)
    return levels, roots


def _handed_down(pivot: DataFrame, paths: DataFrame, items: Sequence[str]) -> DataFrame:
    """Children of a level's parents with their paths: their siblings, then the parent's path."""
    paths = paths.select("g", F.col("place").alias("parent"), "subroot", "path")

    slots = pivot.withColumn("held", F.array(*[F.col(f"c{k}.digest") for k in range(FANOUT)]))

    def child(item: Column, k: Column) -> Column:
        own = F.struct(
            F.array_join(F.slice("held", F.lit(1), k), "").alias("before"),
            F.array_join(F.slice("held", k + 2, F.lit(FANOUT)), "").alias("after"),
        )
        place = F.col("parent") * FANOUT + k
        return F.struct(place.alias("place"), item.alias("item"), F.concat(F.array(own), F.col("path")).alias("path"))

    children = F.transform(F.array(*[f"c{k}" for k in range(FANOUT)]), child)
    rows = slots.join(paths, ["g", "parent"]).select("g", "subroot", F.inline(children))
    return rows.where("item is not null").select("g", "place", *[f"item.{c}" for c in items], "subroot", "path")


def _paths(levels: list[DataFrame], roots: list[DataFrame], above: DataFrame, items: Sequence[str]) -> DataFrame:
    """All leaves with their paths; ``above`` has ``g``, ``subroot`` and the path of the groups' roots."""

    def started(height: int) -> DataFrame:
        names = items if height == 0 else ["digest"]
        return roots[height].join(above, "g").select("g", "place", *names, "subroot", "path")

    paths = started(len(levels))
    for height in reversed(range(len(levels))):
        names = items if height == 0 else ["digest"]
        paths = _handed_down(levels[height], paths, names).unionByName(started(height))
    return paths


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda held, step: hashed(step["before"], held, step["after"]))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, digest: Column, group: str = "source", order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``rows`` with ``leaf``, ``subroot``, ``root`` and ``path``; clashing columns are replaced.

    ``digest`` makes the leaf from a row. ``path`` holds the siblings before and
    after the node, level by level from the leaf to the root: ``folded(leaf, path)``
    is ``root``. All columns travel with the leaves, so give only those that are wanted.

    Groups stand in the order of their text, null first; null is a group of its own.
    Leaves stand in the order of ``order`` (null first) and, where that is equal, of
    their digests, so the root does not depend on the order of the rows. Repeated rows
    are leaves of their own. A group of one leaf is that leaf. An empty table gives an
    empty result.
    """
    kept = [c for c in rows.columns if c not in ("leaf", "subroot", "root", "path")]
    group_key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(
        group_key.alias("g"),
        digest.alias("digest"),
        *[F.col(c).alias(f"by_{i}") for i, c in enumerate(order)],
        F.struct(*kept).alias("kept"),
    )
    leaves = _numbered(leaves, [f"by_{i}" for i in range(len(order))] + ["digest"])
    items = ["digest", "kept"]
    leaves = staged(leaves.select("g", "n", "place", *items), "manifest-leaves")
    levels, roots = _climbed(leaves)
    tops = reduce(DataFrame.unionByName, [r.select("g", "digest") for r in roots])
    # The groups' roots are one group more, told apart by the groups they stand for.
    tops = staged(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "manifest-subroots")
    tops = staged(_numbered(tops, ["of"]).select("g", "n", "place", "digest", "of"), "manifest-tops")
    top_levels, top_roots = _climbed(tops)
    root = top_roots[-1].select("digest").first()
    start = top_roots[-1].select("g", F.lit(None).cast("string").alias("subroot"), F.array().cast(_PATH).alias("path"))
    above = _paths(top_levels, top_roots, start, ["digest", "of"])
    above = staged(above.select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "path"), "manifest-paths")
    out = _paths(levels, roots, above, items)
    return out.select(
        *[F.col("kept")[c].alias(c) for c in kept],
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"),
        "path",
    )


def _lowered(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op13_merkle_manifest(spark, folder: str) -> DataFrame:
    """All documents proved against the dataset's root, one in five after tampering."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = leaf_digest(*[_lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    rows = docs.select("doc_id", "source", leaf_digest(*map(F.col, FIELDS)).alias("own"), F.when(tampered, changed).alias("changed"))
    out = manifest(rows, F.col("own"))
    back = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL climbs: enough for 16**7 leaves of a source.
_SQL_LEVELS = 7


def _sql_tree(name: str, start: str, levels: int = _SQL_LEVELS) -> str:
    """Tables ``{name}_0`` (g, place, n, h) to ``{name}_{levels}``, and the siblings of each node beside it."""
    parts = [f"{name}_0 AS ({start})"]
    for i in range(levels):
        run = f"PARTITION BY g, place // {FANOUT} ORDER BY place"
        parts.append(
            f"{name}_s{i} AS (SELECT g, place, n,"
            f" CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS b,"
            f" CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS a"
            f" FROM {name}_{i})"
        )
        parts.append(
            f"{name}_{i + 1} AS (SELECT g, place // {FANOUT} AS place, CAST(ceil(max(n) / {FANOUT}.0) AS BIGINT) AS n,"
            f" CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE max(h) END AS h"
            f" FROM {name}_{i} GROUP BY ALL)"
        )
    return ", ".join(parts)


def _sql_leaf(text: str) -> str:
    cells = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cells
    ) + ")"


def _sql_crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    bit = "xor(c >> 1, (c & 1) * 3988292384)"
    steps = f"list_reduce(list_concat([{{v}}], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: {bit})"
    byte = steps.format(v="xor(r, x)")
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda r, x: {byte}), 4294967295)"


def contract_sql() -> str:
    """The contract's rows in SQL."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tree = _sql_tree("lv", "SELECT g, place, n, leaf AS h FROM numbered")
    top_start = (
        "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n, h, g AS of"
        f" FROM lv_{_SQL_LEVELS}"
    )
    top = _sql_tree("tp", "SELECT g, place, n, h FROM tops")
    joins, proofs = [], []
    for name, key, place in (("lv", "l.g", "l.place"), ("tp", "''", "t.place")):
        for i in range(_SQL_LEVELS):
            side = f"{name}{i}"
            joins.append(f"JOIN {name}_s{i} AS {side} ON {side}.g = {key} AND {side}.place = {place} // {FANOUT**i}")
            proofs += [f"coalesce({side}.b, '')", f"coalesce({side}.a, '')"]
    columns = ", ".join(f"{n}{i}.b AS {n}{i}b, {n}{i}.a AS {n}{i}a" for n in ("lv", "tp") for i in range(_SQL_LEVELS))
    ctes = [
        f"hashed AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_sql_leaf('text')} AS leaf,"
        f" CASE WHEN ({_sql_crc32('CAST(doc_id AS VARCHAR)')}) % 5 = 0 THEN {_sql_leaf(lowered)} END AS changed FROM documents)",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,"
        " count(*) OVER (PARTITION BY g) AS n FROM hashed)",
        tree,
        f"tops AS ({top_start})",
        top,
        f"joined AS (SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256({' || '.join(proofs)}) AS proof_sha256,"
        f" coalesce(changed, leaf) AS f0, {columns} FROM numbered l JOIN tops t ON t.of = l.g JOIN tp_{_SQL_LEVELS} r ON true {' '.join(joins)})",
    ]
    last = "joined"
    for step, (n, i) in enumerate((n, i) for n in ("lv", "tp") for i in range(_SQL_LEVELS)):
        c = f"{n}{i}"
        ctes.append(
            f"folded_{step} AS (SELECT * REPLACE (CASE WHEN {c}b IS NULL THEN f0 ELSE sha256({c}b || f0 || {c}a) END AS f0) FROM {last})"
        )
        last = f"folded_{step}"
    return (
        f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, f0 AS folded_root, f0 = root AS verified FROM {last}"
    )


CONTRACT_SQL = contract_sql()
