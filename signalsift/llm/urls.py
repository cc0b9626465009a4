"""URL filter over a sorted array of digests.

Rules are ``(host, path, verdict)``. Host and path of a rule form one string;
the strings, sorted by their 64-bit xxhash, are packed into three arrays:
digests, offsets, bytes. A task maps them into memory from one file, probes all
candidate strings of a batch of urls by vectorised binary search, and compares
the stored full string, so an equal digest alone is no hit.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are sent to the tasks in blocks of at most so many bytes; each block is a pass over the urls.
BLOCK_BYTES = 64 << 20

VERDICTS = ("allow", "block")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


class DigestArray:
    """Sorted digests of strings, the strings and a number for each, in one memory map."""

    def __init__(self, rules: Iterable[tuple[bytes, int]]):
        held = sorted((xxhash.xxh64_intdigest(text), text, value) for text, value in rules)
        digests = np.array([h[0] for h in held], np.uint64)
        ends = np.cumsum([0, *(len(h[1]) for h in held)]).astype(np.uint64)
        values = np.array([h[2] for h in held], np.uint64)
        self.size = len(held)
        self.image = digests.tobytes() + ends.tobytes() + values.tobytes() + b"".join(h[1] for h in held) + b"\0"
        self._map: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"size": self.size, "image": self.image, "_map": None}

    def _mapped(self) -> np.ndarray:
        if self._map is None:
            with tempfile.TemporaryFile() as file:  # has no name; it goes with the map
                file.write(self.image)
                file.flush()
                self._map = np.memmap(file, np.uint8, "r")
        return self._map

    def probe(self, texts: list[bytes]) -> np.ndarray:
        """The value stored for each text, -1 if there is none."""
        found = np.full(len(texts), -1, np.int64)
        if not texts or not self.size:
            return found
        held, n = self._mapped(), self.size
        digests = held[: 8 * n].view(np.uint64)
        ends = held[8 * n : 8 * (2 * n + 1)].view(np.uint64).astype(np.int64)
        values = held[8 * (2 * n + 1) : 8 * (3 * n + 1)].view(np.uint64)
        blob = held[8 * (3 * n + 1) :]
        asked = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        left = np.searchsorted(digests, asked, "left")
        right = np.searchsorted(digests, asked, "right")
        for i in np.flatnonzero(right > left):
            for k in range(left[i], right[i]):
                if blob[ends[k] : ends[k + 1]].tobytes() == texts[i]:
                    found[i] = values[k]
                    break
        return found


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _blocks(rules: list[Rule]) -> Iterator[list[tuple[int, Rule]]]:
    block: list[tuple[int, Rule]] = []
    size = 0
    for number, rule in enumerate(rules):
        cost = len(rule.text.encode()) + 24
        if block and size + cost > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((number, rule))
        size += cost
    yield block


def _candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Host and its parent domains, each with every prefix of the path that has a rule's length."""
    domains = [host]
    at = host.find(".")
    while at >= 0:
        domains.append(host[at + 1 :])
        at = host.find(".", at + 1)
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [f"{d}\0{p}".encode() for d in domains for p in starts]


def judged(df: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``; clashing columns are replaced.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest (host and path, ties: the host, then the first) wins. A url
    without a rule gets ``rule`` null and the ``default`` verdict. Null, empty and
    malformed urls have empty parts and no rule. Rows are kept as they are,
    repeats included. There is no shuffle.
    """
    if default not in VERDICTS or any(r.verdict not in VERDICTS for r in rules):
        raise ValueError(f"verdicts are {VERDICTS}")
    host, path = url_parts(F.col(url))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "rule_no", "__rule_rank")]
    # The rank of the best rule so far goes from pass to pass with its number.
    rank_so_far = F.array(*[F.lit(0).cast("long")] * 3).alias("__rule_rank")
    out = df.select(*kept, host.alias("host"), path.alias("path"), F.lit(-1).cast("long").alias("rule_no"), rank_so_far)
    rank = [(len(r.text), len(r.host), -n) for n, r in enumerate(rules)]
    for block in _blocks(rules):
        array = DigestArray((f"{r.host}\0{r.path}".encode(), n) for n, r in reversed(block))
        lengths = sorted({len(r.path) for _, r in block})
        shared = df.sparkSession.sparkContext.broadcast((array, lengths, {n: rank[n] for n, _ in block}))
        out = out.mapInArrow(_prober(shared), out.schema)
    numbers = F.col("rule_no")
    texts = [F.when(numbers == n, F.struct(F.lit(r.text).alias("t"), F.lit(r.verdict).alias("v"))) for n, r in enumerate(rules)]
    if len(rules) > 64:
        spark = df.sparkSession
        names = spark.createDataFrame([(n, r.text, r.verdict) for n, r in enumerate(rules)], "rule_no long, rule string, verdict string")
        out = out.join(names, "rule_no", "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
        return out.select(*kept, "host", "path", "rule", "verdict")
    hit = F.coalesce(*texts) if texts else F.lit(None).cast("struct<t:string,v:string>")
    return out.select(*kept, "host", "path", hit["t"].alias("rule"), F.coalesce(hit["v"], F.lit(default)).alias("verdict"))


def _prober(shared):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array, lengths, rank = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            best = batch.column("rule_no").to_numpy(zero_copy_only=False).copy()
            ranks = [tuple(r) for r in batch.column("__rule_rank").to_pylist()]
            texts: list[bytes] = []
            rows: list[int] = []
            for row, (host, path) in enumerate(zip(hosts, paths)):
                if host:
                    tried = _candidates(host, path, lengths)
                    texts += tried
                    rows += [row] * len(tried)
            for k in np.flatnonzero((numbers := array.probe(texts)) >= 0):
                row, number = rows[k], int(numbers[k])
                if best[row] < 0 or rank[number] > ranks[row]:
                    best[row], ranks[row] = number, rank[number]
            columns = dict(zip(batch.schema.names, batch.columns)) | {"rule_no": pa.array(best, pa.int64()), "__rule_rank": pa.array(ranks, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return probe


#: The rules of the registered query, as its contract fixes them.
CONTRACT_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]

CONTRACT_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), judged AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM judged
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op7_url_filter(spark, folder: str) -> DataFrame:
    """Every page's url judged by the four rules; urls without a rule are allowed."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judged(pages, CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict")
