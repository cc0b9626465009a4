"""The manifest against a tree built with hashlib."""

from __future__ import annotations

import hashlib
import random
import zlib

import compare
from pyspark.sql import functions as F

from signalsift.llm import manifest as m

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    cells = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return h(*cells)


def climbed(nodes):
    """Root and, for each leaf, its siblings before and after it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[n].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], paths


def expected(rows):
    """Contract rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, held = [], []
    for g in order:
        of = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climbed([leaf(r) for r in of])
        tops.append(root)
        held += [(r, root, p, len(tops) - 1) for r, p in zip(of, paths)]
    root, top_paths = climbed(tops)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for r, sub, path, g in held:
        path = path + top_paths[g]
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        now = leaf((*r[:4], r[4].translate(lower) if tampered and r[4] is not None else r[4]))
        for before, after in path:
            now = h(before, now, after)
        out.append((r[0], leaf(r), sub, root, h(*[x for p in path for x in p]), now, now == root))
    return sorted(out, key=str)


def proved(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, m.op13_merkle_manifest(spark, str(folder)).collect()), key=str)


def odd_rows(seed=3):
    random.seed(seed)
    texts = ["Alpha Beta", "", None, "ÄÖ é 日本 A", "x" * 100_000 + "Z", "plain"]
    rows = [(i, "hot", "en", 3, random.choice(texts)) for i in range(300)]
    rows += [(i, f"s{i % 40}", random.choice(["de", None]), random.choice([1, None]), random.choice(texts)) for i in range(1000, 1100)]
    rows += [(7, "hot", "en", 3, "Other Text")] * 3 + [(None, "hot", None, None, None)] * 20 + [(None, None, None, None, "A")]
    rows += [(5000 + i, "é", "en", 1, "Q") for i in range(17)] + [(9000, "", "en", 1, "Lone Leaf")]
    return rows


def test_contract_rows(spark, tmp_path):
    rows = odd_rows()
    assert proved(spark, rows, tmp_path) == expected(rows)


def test_one_leaf_and_one_source(spark, tmp_path):
    one = [(5, "s", "en", 1, "Aa")]
    assert proved(spark, one, tmp_path / "a") == expected(one)
    many = [(i, None, "en", 1, "Aa") for i in range(257)]
    assert proved(spark, many, tmp_path / "b") == expected(many)


def test_empty_table(spark, tmp_path):
    assert proved(spark, [], tmp_path) == []


def test_clashing_columns_and_order_of_rows(spark):
    rows = [(i % 30, f"s{i % 3}", "leaf", "path") for i in range(60)]
    shape = "doc_id int, source string, leaf string, path string"
    found = []
    for seed in (1, 2):
        random.seed(seed)
        df = spark.createDataFrame(random.sample(rows, 60), shape).withColumn("g", F.lit("clash")).withColumn("place", F.lit(1))
        out = m.manifest(df, m.leaf_digest(F.col("doc_id"), F.col("source")))
        assert out.columns == ["doc_id", "source", "g", "place", "leaf", "subroot", "root", "path"]
        found.append(sorted((r["doc_id"], r["source"], r["leaf"], r["root"], str(r["path"])) for r in out.collect()))
    assert found[0] == found[1]
    folded = out.select(m.folded(F.col("leaf"), F.col("path")).alias("now"), "root").distinct().collect()
    assert [r["now"] == r["root"] for r in folded] == [True]


def test_contract_sql(spark, folder):
    con = compare.connect(folder)
    assert compare.differences(m.op13_merkle_manifest(spark, folder), con, m.CONTRACT_SQL) == []
