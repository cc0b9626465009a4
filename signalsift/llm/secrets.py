"""Secrets in texts: candidates by form, false positives removed by a random forest.

A candidate is a run of at least ``SHORTEST`` characters of keys and tokens with
a digit in it, a key with a known beginning, the value of a bearer header, the password of an
address, or the value of an assignment to a name like ``password``, with or without digits and
as long as it is. Its features are length, kinds of characters, how they follow each other, how much of it
dictionary words cover, whether it is part of a path or address, and the words
before it. The forest is trained by Spark ML on labelled findings; its trees are then
arrays, so that a text is searched, judged and cleaned in one pass.

The labelled findings are made here by a seeded writer: keys of many kinds in
the sentences, code and settings where they leak, and what is taken for keys:
checksums, identifiers, versions, numbers, file names, placeholders.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.llm.batches import slices, sole_cache, text_bytes

SHORTEST = 12
#: Bytes before and after a candidate that are looked at.
AROUND = 48
#: What a cleaned text has instead of a secret.
MASK = "[secret]"
TREES, DEPTH = 40, 8
_SLICE = 4 << 20

_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-."]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Names whose assigned value may be a secret, and those of harmless ones (fixed values).
SECRET_WORDS = "token secret key apikey password passwd pwd passphrase credential credentials auth authorization bearer private access signature sas".split()
HARMLESS_WORDS = "sha sha1 sha256 md5 commit checksum digest hash etag uuid guid id revision version build isbn order invoice phone card serial sample example file path image".split()
PLACEHOLDERS = ("example", "placeholder", "changeme", "your", "xxxx", "dummy", "sample", "test", "12345678", "abcdef")
DICTIONARY = frozenset(
    "the and for with this that from have not are was you all can has one our out new use get set data file name user test main index page view list item type value time date node path home page image photo report final draft version release build config server client local public static assets module package library common model train report invoice order customer product service system number section chapter summary".split()
)
_NAMED = "|".join(sorted((*SECRET_WORDS, "api[_-]?key"), key=len, reverse=True))
#: The end of a name with one of the words in it (``db_password``, ``apiKey``, ``secret_2``), before = or :.
_ASSIGNED = re.compile(
    rf"(?:(?<![a-zA-Z])(?i:{_NAMED})|(?<=[a-z])(?:{'|'.join(w.capitalize() for w in SECRET_WORDS)}))s?(?:[_-]\w{{0,16}}|[0-9]{{1,4}})?(?:\\?[\"'`])?\s{{0,8}}:?\Z".encode()
)
#: Bytes before = or : in which that name stands.
_NAME = 64
#: A value up to white space, its closing quote or the next assignment behind a separator; as long as it is.
_SCHEME = r"(?:(?i:bearer|basic|token)[ \t]+)?"
_VALUE = re.compile(
    rf">?\s{{0,8}}(?:\\?\"{_SCHEME}([^\s\"]+)|\\?'{_SCHEME}([^\s']+)|\\?`{_SCHEME}([^\s`]+)"
    rf"|{_SCHEME}((?:[^\s\"'<>`&;,?]+|(?![&;,?][A-Za-z_][\w.-]{{0,40}}[=:])[&;,?])+))".encode()
)
_BEARER = re.compile(rb"(?<![A-Za-z])[Bb](?:earer|EARER)[ \t]+([^\s\"'<>`,;]+)")
#: The password of user:password@host.
_LOGIN = re.compile(rb"://[^\s/?#:@\"'<>]*:([^\s/?#\"'<>]+)@(?=[\w\[])")
#: Beginnings of keys (fixed values); such a key needs no digit.
PREFIXES = ("AKIA", "ASIA", "AIza", "eyJ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "sk-", "npm_", "hf_")
_PREFIXED = re.compile(rb"(?<![A-Za-z0-9])(?:%s)[A-Za-z0-9_.+/=-]+" % "|".join(PREFIXES).encode())
_WORDS = re.compile(r"[A-Za-z]+[0-9]*")

NAMES = (
    "length digits uppers lowers symbols classes changes entropy distinct longest_run hexadecimal dictionary "
    "path address mail quoted assigned secret_word harmless_word placeholder dashes dots prefix vowels alternating"
).split()


def features(value: str, before: str, after: str) -> list[float]:
    """The numbers of ``NAMES`` for a candidate and what stands around it."""
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    counts = Counter(kinds)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    letters = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in letters.values())
    longest = run = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    low = value.lower()
    covered = sum(len(w) for w in re.findall(r"[a-z]{3,}", low) if w in DICTIONARY)
    words = [w.lower() for w in _WORDS.findall(before)][-4:]
    context = {p for w in words for p in (w, *re.split(r"[_\d]+", w))}
    last = before.rstrip().rstrip("\"'").rstrip()
    alternating = sum(a == "l" and b == "u" or a == "u" and b == "l" for a, b in zip(kinds, kinds[1:]))
    return [
        float(n),
        counts["d"] / n,
        counts["u"] / n,
        counts["l"] / n,
        counts["s"] / n,
        float(len(counts)),
        changes / n,
        entropy,
        len(letters) / n,
        longest / n,
        sum(c in "0123456789abcdef" for c in value) / n,
        covered / n,
        float(value.count("/") > 1 or before[-1:] in ("/", "\\") or after[:1] in ("/", "\\")),
        float("://" in before[-24:] or "www." in before[-24:] or after[:2] in (".c", ".o", ".n")),
        float(before[-1:] == "@" or after[:1] == "@"),
        float(before[-1:] in ("\"", "'", "`") and after[:1] in ("\"", "'", "`")),
        float(last[-1:] in ("=", ":")),
        float(any(w in context for w in SECRET_WORDS)),
        float(any(w in context for w in HARMLESS_WORDS)),
        float(any(p in low for p in PLACEHOLDERS)),
        value.count("-") / n,
        value.count(".") / n,
        float(bool(re.match(r"[A-Za-z]{2,6}[_-]", value)) or value[:4] in ("AKIA", "AIza", "eyJh")),
        sum(c in "aeiou" for c in low) / n,
        alternating / n,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1: a leaf), threshold, left and right child, share of secrets."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        for _ in range(DEPTH + 1):
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                break
            value = np.take_along_axis(x, np.maximum(feature, 0), axis=1)
            step = np.where(value <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, step, node)
        return self.share[node].mean(axis=1)


def as_arrays(model: RandomForestClassificationModel) -> Forest:
    rows: list[list[float]] = []

    def put(node) -> int:
        at = len(rows)
        stats = node.impurityStats()
        both = list(stats.stats())
        rows.append([-1, 0.0, -1, -1, both[1] / max(1e-9, sum(both[:2]))])
        if node.subtreeDepth() > 0:
            split = node.split()
            left, right = put(node.leftChild()), put(node.rightChild())
            rows[at][:4] = [split.featureIndex(), split.threshold(), left, right]
        return at

    roots = [put(tree._call_java("rootNode")) for tree in model.trees]
    columns = list(zip(*rows))
    return Forest(
        np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64),
        np.array(columns[3], np.int64), np.array(columns[4]), np.array(roots, np.int64),
    )


class _Writer:
    """Writes labelled findings: a candidate with what stands before and after it."""

    def __init__(self, seed: int):
        self.random = np.random.default_rng([20_240_917, seed])

    def pick(self, *choices: str) -> str:
        return choices[int(self.random.integers(len(choices)))]

    def chars(self, alphabet: str, low: int, high: int | None = None) -> str:
        n = int(self.random.integers(low, (high or low) + 1))
        return "".join(self.random.choice(list(alphabet), n))

    def word(self) -> str:
        return self.chars("aeiourstlnmdéü", 2, 8)

    def prose(self) -> str:
        return " ".join(self.word() for _ in range(int(self.random.integers(2, 6))))

    HEX, LOW = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"
    ALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + LOW

    def secret(self) -> tuple[str, str, str]:
        value = [
            lambda: self.chars(self.HEX, 40),
            lambda: self.chars(self.HEX, 32),
            lambda: self.chars(self.HEX, 64),
            lambda: "AKIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
            lambda: self.pick("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-", "npm_") + self.chars(self.ALL, 24, 40),
            lambda: "AIza" + self.chars(self.ALL + "_-", 35),
            lambda: "eyJh" + self.chars(self.ALL, 20, 60) + "." + self.chars(self.ALL, 30, 80),
            lambda: self.chars(self.ALL + "+/", 40),
            lambda: self.chars(self.ALL, 20, 48),
            lambda: self.chars(self.ALL + "!#%&*", 10, 18),
        ][int(self.random.integers(10))]()
        name = self.pick("token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "private_key", "key", "API_KEY", "SECRET")
        before, after = [
            (f'{self.prose()} {name} = "', f'" {self.prose()}'),
            (f"{name}: ", f"\n{self.prose()}"),
            (f"{name}=", f" {self.prose()}"),
            (f'"{name}": "', '",'),
            ("Authorization: Bearer ", "\n"),
            (f"{self.prose()} ", f" {self.prose()}") if value[:4] in ("AKIA", "ghp_", "gho_", "AIza", "eyJh", "sk_l") else (f"export {name}='", "'"),
        ][int(self.random.integers(6))]
        return value, before, after

    def plain(self) -> str:
        """What stands behind a secret's name in code and prose without being one."""
        one, two = self.word() + self.word(), self.word()
        return self.pick(
            one, one.capitalize(), f"self.{one}", f"{one}_{two}", f"{one}.{two}({two}", f"{one}(", f"None){self.pick(':', '')}", f"{one}{two.capitalize()}", f"${{{one.upper()}}}",
            self.pick("string", "required", "optional", "invalid", "incorrect", "missing", "function", "public", "default"),
        )

    def harmless(self) -> tuple[str, str, str]:
        value, name = [
            (lambda: (self.chars(self.HEX, 40), self.pick("commit", "sha1", "revision"))),
            (lambda: (self.chars(self.HEX, 32), self.pick("md5", "checksum", "etag", "hash"))),
            (lambda: (self.chars(self.HEX, 64), self.pick("sha256", "digest"))),
            (lambda: ("-".join(self.chars(self.HEX, k) for k in (8, 4, 4, 4, 12)), self.pick("uuid", "guid", "id", ""))),
            (lambda: (self.chars("0123456789", 12, 19), self.pick("card", "order", "phone", "isbn", "", ""))),
            (lambda: (".".join(self.chars("0123456789", 1, 4) for _ in range(4)), self.pick("version", "build", ""))),
            (lambda: (self.word() + "." + self.chars("0123456789", 1, 3), "")),
            (lambda: ("/".join(self.word() for _ in range(4)) + self.chars("0123456789", 1, 4) + ".html", self.pick("path", "file", ""))),
            (lambda: (self.pick("example", "your", "xxxx", "test") + self.pick("_", "-", "") + self.pick("key", "token", "secret") + self.chars("0123456789", 4, 8), self.pick("token", "key", "secret"))),
            (lambda: ("-".join(self.chars("0123456789", k) for k in (4, 2, 2)) + "-" + self.word(), self.pick("date", ""))),
            (lambda: (self.word() + "_" + self.word() + "_" + self.chars("0123456789", 1, 4), "")),
            (lambda: (self.word() * 2 + self.chars("0123456789", 1, 4), "")),
            (lambda: (self.plain(), self.pick("token", "key", "password", "secret", "auth", "access", "private", "api_key"))),
        ][int(self.random.integers(13))]()
        if self.random.random() < 0.5 or not name:
            before, after = f"{self.prose()} {name} " if name else f"{self.prose()} ", f" {self.prose()}"
        else:
            before, after = f"{self.prose()} {name}{self.pick(': ', ' = ', ' = ' + chr(34), '=')}", f"{self.pick(chr(34), '', ' ')} {self.prose()}"
        if self.random.random() < 0.1:
            before, after = f"{self.prose()} https://{self.word()}.com/{self.word()}/", f" {self.prose()}"
        return value, before, after


def labelled_findings(count: int = 3000) -> list[tuple[int, list[float]]]:
    """Labels (1: a secret) and features of written findings."""
    out = []
    for seed in range(count):
        writer = _Writer(seed)
        label = seed % 2
        value, before, after = writer.secret() if label else writer.harmless()
        out.append((label, features(value, before[-AROUND:], after[:AROUND])))
    return out


def fitted(spark: SparkSession, findings: list[tuple[int, list[float]]] | None = None) -> Forest:
    """The forest of labelled findings; Spark ML trains it."""
    rows = [(float(y), x) for y, x in findings or labelled_findings()]
    rows = spark.createDataFrame(rows, "label double, x array<double>")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=17)
    return as_arrays(forest.fit(rows.select("label", array_to_vector("x").alias("features"))))


def candidates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Row, first and last byte of all candidates in a buffer of texts, in order; they do not overlap."""
    if not len(data):
        return []
    key = _KEY[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(key & (~np.concatenate([[False], key[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(key & (~np.concatenate([key[1:], [False]]) | edge[1:])) + 1
    long_ = ends - starts >= SHORTEST
    starts, ends = starts[long_], ends[long_]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    some = digits[ends] > digits[starts]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return _merged(_runs(data, rows[some], starts[some], ends[some]) + _assigned(data, offsets) + _known(data, offsets))


def _assigned(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Values assigned to names of ``SECRET_WORDS``, with or without digits, whatever their length."""
    out = []
    raw, last = data.tobytes(), 0
    for at in np.flatnonzero((data == 61) | (data == 58)).tolist():  # = and :
        if at < last:
            continue  # part of the value before
        row = int(np.searchsorted(offsets, at, "right") - 1)
        low, high = int(offsets[row]), int(offsets[row + 1])
        if _ASSIGNED.search(raw[max(low, at - _NAME) : at]):
            value = _VALUE.match(raw, at + 1, high)
            if value:
                begin = value.start(value.lastindex)
                found = value[value.lastindex].rstrip(b".,;)\\" if value.lastindex == 4 else b"\\")
                begin += len(found) - len(found.lstrip(b"="))
                last = begin + len(found.lstrip(b"="))
                if last - begin >= 6:
                    out.append((row, begin, last))
    return out


def _known(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Values of bearer headers, passwords of addresses, and keys with a known beginning."""
    out = []
    # A line's end between the texts, so that nothing is found across two of them.
    lines = np.insert(data, offsets[1:-1], 10).tobytes()
    starts = offsets + np.arange(len(offsets))
    for pattern, group, least in ((_BEARER, 1, 6), (_LOGIN, 1, 6), (_PREFIXED, 0, SHORTEST)):
        for hit in pattern.finditer(lines):
            found = hit[group].rstrip(b"./-+")
            row = int(np.searchsorted(starts, hit.start(), "right") - 1)
            if len(found) >= least:
                begin = hit.start(group) - row
                out.append((row, begin, begin + len(found)))
    return out


def _runs(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of a key's characters, without the signs around them and the name before them."""
    found = []
    for row, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist()):
        front, rest = _trimmed(data[a:b].tobytes())
        if len(rest) >= 6:
            found.append((row, a + front, a + front + len(rest)))
    return found


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of each row in order, those that overlap as one."""
    out: list[tuple[int, int, int]] = []
    for row, a, b in sorted(spans):
        if out and out[-1][0] == row and a < out[-1][2]:
            out[-1] = (row, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((row, a, b))
    return out


def _trimmed(value: bytes) -> tuple[int, bytes]:
    """A run without the signs around a key: how many go in front, and the rest."""
    front = len(value) - len(value.lstrip(b"=/.-+"))
    rest = value[front:].rstrip(b"./-+")
    name, sign, tail = rest.partition(b"=")
    if sign and len(tail.strip(b"=")) >= 8 and len(name) < 24:
        return front + len(name) + 1, tail
    return front, rest


def _scanner(shared, least: float, clean: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        sole_cache("secrets", lambda: None)
        for batch in batches:
            column = batch.column("text")
            data, offsets = text_bytes(column)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, stop in slices(offsets, _SLICE):
                low, high = int(offsets[first]), int(offsets[stop])
                part, places = data[low:high], offsets[first : stop + 1] - low
                spots, x = [], []
                for row, a, b in candidates(part, places):
                    value = part[a:b].tobytes().decode("utf-8", "replace")
                    before = part[max(int(places[row]), a - AROUND) : a].tobytes().decode("utf-8", "ignore")
                    after = part[b : min(int(places[row + 1]), b + AROUND)].tobytes().decode("utf-8", "ignore")
                    x.append(features(value, before, after))
                    spots.append((row, a, b))
                if not spots:
                    continue
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                for (row, a, b), score in zip(spots, forest.scores(np.array(x))):
                    if score >= least:
                        start, end = int(points[a] - points[places[row]]), int(points[b] - points[places[row]])
                        found[first + row].append({"start": start, "stop": end, "score": float(score)})
            columns, names = list(batch.columns), list(batch.schema.names)
            if clean:
                texts = column.to_pylist()
                for i, spans in enumerate(found):
                    for span in reversed(spans):
                        texts[i] = texts[i][: span["start"]] + MASK + texts[i][span["stop"] :]
                columns[names.index("text")] = pa.array(texts, pa.string())
            else:
                del columns[names.index("text")], names[names.index("text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _FINDING)], names=[*names, "findings"])

    return scan


_FINDING = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def scanned(docs: DataFrame, forest: Forest | None = None, text: str = "text", least: float = 0.5, clean: bool = False) -> DataFrame:
    """``docs`` with ``findings``: spans in code points and scores of the secrets in ``text``, in order.

    With ``clean`` the text stays, each secret replaced by ``MASK``; else it is left out.
    A clashing column is replaced. A null or empty text has no findings and stays as it is; rows come back
    once each; there is no shuffle. Whole texts are read.
    """
    kept = [c for c in docs.columns if c != "findings" and c != text]
    rows = docs.select(*[F.col(c).alias(f"kept_{c}") for c in kept], F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(forest or fitted(docs.sparkSession))
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if clean or f.name != "text")
    out = rows.mapInArrow(_scanner(shared, least, clean), f"{shape}findings array<struct<start:long,stop:long,score:double>>")
    names = {f"kept_{c}": c for c in kept} | {"text": text}
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns])


def op6_secret_scan(spark, folder: str) -> DataFrame:
    """All secrets in all documents: ``doc_id, start, stop, score``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return scanned(docs).select("doc_id", F.inline("findings"))
