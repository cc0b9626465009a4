"""Alignment of two tokenizers' tokens, with corpus-wide counts of their id pairs.

Both tokenizers cut the same bytes; where tokens of both end, a group ends, and
tokens whose byte ranges overlap are linked. A text is cut where neither tokenizer
can look across (before words and lines), and each different piece is tokenised and
aligned once in a worker; texts are then sums over their pieces.

Counts take two passes. The first aligns all texts; every task emits its different
pairs of ids with the number of documents that hold them. The different pairs, dealt to
buckets by hash, get a minimal perfect hash: levels of bits in which a pair that falls
alone has its place. The tasks' counts become dense vectors in the order of the hash,
which are summed up a tree. The second pass aligns the texts again and looks the
counts up; the hash gives some place to any pair, so the key stored there is compared.

A look-up holds one block of at most ``BLOCK_PAIRS`` pairs; more pairs take more
passes, with equal results.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.llm.batches import runs, slices, text_bytes
from signalsift.llm.shingles import mixed
from signalsift.session import released, staged

#: Pairs of a bucket, about; pairs of a block that a look-up holds (24 bytes each), at most.
BUCKET_PAIRS, BLOCK_PAIRS = 1 << 17, 4 << 20
#: Vectors of a bucket that are summed together.
FAN_IN = 8
#: What a worker knows of pieces before it forgets all: their number and their bytes.
CACHE_PIECES, CACHE_BYTES = 400_000, 32 << 20
#: Pairs that a task holds before it emits them.
HELD_PAIRS = 1 << 20
_SLICE = 4 << 20
_STEP = 0x9E3779B97F4A7C15

#: Before a space that follows no space and is followed by what is surely not white space, before a line
#: end that follows a printable sign, and before a stop that follows a letter; nothing else starts a piece.
_PIECES = re.compile(
    rb"[\s\S](?:[^ \n.,:;!?]+|(?<= ) | (?![!-~\xc3-\xe0\xe4-\xf4])|(?<![!-~])\n|(?<![A-Za-z])(?<!\xc3[\xa0-\xb6])[.,:;!?])*"
)
_STOPPED = re.compile("[A-Za-zà-ö][.,:;!?]")


#: Pieces that are tokenised together, with a line's end between them: a space, then no white space of any kind.
_PLAIN = re.compile(rb" (?:[!-~]|[\xc3-\xdf][\x80-\xbf])+")
_TOGETHER = 200


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _different(x: np.ndarray) -> np.ndarray:
    """The different numbers in order; numpy's own hashes integers, which is slower for long arrays."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All entries' bytes one after the other, and their sizes."""
    return np.frombuffer(b"".join(entries), np.uint8), np.fromiter(map(len, entries), np.int64, len(entries))


def _spelled(text: np.ndarray, lengths: np.ndarray, flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each piece is what its tokens' entries spell."""
    at = np.concatenate([[0], np.cumsum(counts)])
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    good = np.diff(ends[at]) == lengths
    # The others are compared byte by byte.
    kept = np.repeat(good, counts)
    made = flat[ranges((np.cumsum(sizes) - sizes)[ids[kept]], sizes[ids[kept]])]
    same = made == text[np.repeat(good, lengths)]
    wrong = np.concatenate([[0], np.cumsum(~same)])[np.concatenate([[0], np.cumsum(lengths * good)])]
    return good & (np.diff(wrong) == 0)


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Aligner:
    """Tokens of a byte-level BPE file (A) and of a sentencepiece model (B), aligned piece by piece."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.a_bytes[number] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_size = self.b.get_piece_size()
        entries = [self.b.id_to_piece(i) for i in range(self.b_size)]
        told = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(self.b_size)]
        self.b_bytes = [
            bytes([int(e[3:5], 16)]) if self.b.is_byte(i) else b"" if told[i] else e.replace("▁", " ").encode()
            for i, e in enumerate(entries)
        ]
        self.space = self.b.piece_to_id("▁")
        #: Whether pieces may be cut at all: no entry of B looks across a word's start, a line's end or a stop.
        self.cuts = all("▁" not in e.lstrip("▁") and "\n" not in e and not _STOPPED.search(e) for e in entries)
        self.a_flat, self.a_sizes = _flat(self.a_bytes)
        self.b_flat, self.b_sizes = _flat(self.b_bytes)
        self.a_digits, self.b_digits = _flat([b"%d," % i for i in range(len(self.a_bytes))]), _flat([b"%d," % i for i in range(self.b_size)])
        #: What a line's end is to each, if it is one token that nothing else holds.
        self.a_line, self.b_line = self.a.token_to_id(next(k for k, v in letters.items() if v == 10)), self.b.piece_to_id("<0x0A>")
        self.generation = 0
        self._forget()

    def _forget(self) -> None:
        self.generation += 1
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.texts: list[bytes] = []
        self.held = 0
        #: Per piece: tokens of A, tokens of B, groups, links; -1 for tokens where it has no alignment.
        self.counts = np.zeros((4, 0), np.int64)
        self.links = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)

    def pieces(self, text: bytes) -> list[bytes]:
        """The pieces of a space and a text."""
        return _PIECES.findall(b" " + text) if self.cuts else [b" " + text]

    def _side(self, encode, line: int, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Ids of many texts without line ends, and their numbers of ids: many in one call, with lines between them."""
        flat: list[int] = []
        sizes = []
        for at in range(0, len(texts), _TOGETHER):
            part = texts[at : at + _TOGETHER]
            ids = np.array(encode("\n".join(part)), np.int64)
            ends = np.append(np.flatnonzero(ids == line), len(ids))
            if len(ends) != len(part):
                raise ValueError("a line end is not one token")
            sizes.append(np.diff(ends, prepend=-1) - 1)
            flat.append(ids[ids != line])
        return np.concatenate(flat), np.concatenate(sizes)

    def _tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all pieces, and how many each piece has."""
        plain = np.fromiter(map(_PLAIN.fullmatch, pieces), object, len(pieces)).astype(bool) & self.cuts
        own = np.flatnonzero(~plain).tolist()
        a_ids, a_sizes, b_ids, b_sizes = [], np.zeros(len(pieces), np.int64), [], np.zeros(len(pieces), np.int64)
        held = np.flatnonzero(plain)
        if len(held):
            texts = [pieces[i].decode() for i in held.tolist()]
            ids, a_sizes[held] = self._side(lambda t: self.a.encode_batch_fast([t], add_special_tokens=False)[0].ids, self.a_line, texts)
            a_ids.append(ids)
            # B writes the first space of a text itself.
            ids, b_sizes[held] = self._side(lambda t: self.b.encode(t[1:], num_threads=1), self.b_line, texts)
            b_ids.append(ids)
        order = np.concatenate([held, own]).astype(np.int64)
        if own:
            texts = [pieces[i].decode("utf-8", "replace") for i in own]
            a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            # Behind a line's end B writes no space of its own; the space before that and the line's end are not ours.
            b = self.b.encode([t[1:] if t[0] == " " else f"\n{t}" for t in texts], num_threads=1)
            before = [self.space, self.b_line]
            b = [ids if t[0] == " " else ids[2:] if ids[:2] == before else [] for t, ids in zip(texts, b)]
            a_sizes[own], b_sizes[own] = [len(x) for x in a], [len(x) for x in b]
            a_ids.append(np.fromiter((i for x in a for i in x), np.int64))
            b_ids.append(np.fromiter((i for x in b for i in x), np.int64))
        # Back to the order of the pieces.
        out = []
        for ids, sizes in ((a_ids, a_sizes), (b_ids, b_sizes)):
            ends = np.zeros(len(pieces), np.int64)
            ends[order] = np.cumsum(sizes[order])
            out += [np.concatenate(ids)[ranges(ends - sizes, sizes)], sizes]
        return tuple(out)

    def _learn(self, pieces: list[bytes]) -> None:
        a_ids, n_a, b_ids, n_b = self._tokens(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = np.frombuffer(b"".join(pieces), np.uint8)
        a_good = _spelled(text, lengths, self.a_flat, self.a_sizes, a_ids, n_a)
        good = a_good & _spelled(text, lengths, self.b_flat, self.b_sizes, b_ids, n_b)
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        a_starts = a_ends - self.a_sizes[a_ids]
        first = np.searchsorted(b_ends, a_starts, "right")
        linked = np.searchsorted(b_ends, a_ends, "left") - first + 1
        links = np.repeat(a_ids, linked) * self.b_size + b_ids[ranges(first, linked)]
        # Groups end where tokens of both end.
        a_at, b_at = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        place = np.minimum(np.searchsorted(b_ends, a_ends), max(0, len(b_ends) - 1))
        a_last = b_ends[place] == a_ends if len(b_ends) else np.zeros(0, bool)
        b_last = np.zeros(len(b_ids), bool)
        b_last[place[a_last]] = True
        groups = np.diff(np.concatenate([[0], np.cumsum(a_last)])[a_at])
        links_at = np.concatenate([[0], np.cumsum(linked)])[a_at]
        self._write(a_ids, a_last, b_ids, b_last, a_at, b_at)
        self.held += int(lengths.sum())
        counts = np.stack([n_a, n_b, groups, np.diff(links_at)])
        counts[0, ~good] = -1
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.ends = np.concatenate([self.ends, links_at[1:] + len(self.links)])
        self.links = np.concatenate([self.links, links])

    def _write(self, a_ids, a_last, b_ids, b_last, a_at, b_at) -> None:
        """The groups' text of each piece: ids of A, ``|``, ids of B, ``;``, the last sign left out."""
        a_group = np.cumsum(a_last) - a_last
        b_group = np.cumsum(b_last) - b_last
        # Behind the ids of A of a group stand those of B, so each id's place follows from the other side's counts.
        a_before = np.concatenate([[0], np.flatnonzero(a_last) + 1])
        b_before = np.concatenate([[0], np.flatnonzero(b_last) + 1])
        place = np.concatenate([np.arange(len(a_ids)) + b_before[a_group], np.arange(len(b_ids)) + a_before[b_group + 1]])
        starts, sizes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        (a_text, a_size), (b_text, b_size) = self.a_digits, self.b_digits
        sizes[place] = np.concatenate([a_size[a_ids], b_size[b_ids]])
        starts[place] = np.concatenate([np.cumsum(a_size)[a_ids] - a_size[a_ids], len(a_text) + np.cumsum(b_size)[b_ids] - b_size[b_ids]])
        written = np.concatenate([a_text, b_text])[ranges(starts, sizes)]
        ends = np.cumsum(sizes)
        written[ends[place[: len(a_ids)][a_last]] - 1] = ord("|")
        written[ends[place[len(a_ids) :][b_last]] - 1] = ord(";")
        ends = np.concatenate([[0], ends])[a_at + b_at].tolist()
        whole = written.tobytes()
        self.texts += [whole[i : max(i, j - 1)] for i, j in zip(ends, ends[1:])]

    def numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece numbers of all texts, bounds of each text, and whether it has tokens: a text is good if all its pieces are."""
        if len(self.texts) > CACHE_PIECES or self.held > CACHE_BYTES:
            self._forget()
        found = [self.pieces(t) if t else [] for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        # A piece that is not known gets the next number.
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64, int(bounds[-1]))
        if len(self.number) > len(self.texts):
            self._learn(list(islice(self.number, len(self.texts), None)))
        bad = np.concatenate([[0], np.cumsum(self.counts[0, numbers] < 0)])
        good = (bad[bounds[1:]] == bad[bounds[:-1]]) & (np.diff(bounds) > 0)
        return numbers, bounds, good


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner."""
    return Aligner(a_path, b_path)


def document_pairs(known: Aligner, texts: list[bytes]) -> np.ndarray:
    """The pairs of each text, each once for a text, in any order."""
    numbers, bounds, good = known.numbered(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keep = good[doc]
    doc, numbers = doc[keep], numbers[keep]
    pieces = len(known.texts)
    once = _different(doc * pieces + numbers)
    doc, numbers = once // pieces, once % pieces
    sizes = known.ends[numbers + 1] - known.ends[numbers]
    pairs = known.links[ranges(known.ends[numbers], sizes)]
    span = len(known.a_bytes) * known.b_size
    return _different(np.repeat(doc, sizes) * span + pairs) % span


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at, counts)
    return pairs, total


def _spot(pairs: np.ndarray) -> np.ndarray:
    """31 bits of a pair that deal it to a bucket."""
    return (mixed(pairs.astype(np.uint64)) >> np.uint64(33)).astype(np.int32)


def _counter(a_path: str, b_path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        task = TaskContext.get().partitionId()
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def emitted() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pairs), 100_000):
                part = pairs[i : i + 100_000]
                columns = [np.full(len(part), task, np.int32), _spot(part), part, counts[i : i + 100_000]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["task", "spot", "pair", "docs"])

        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for low, high in slices(at, _SLICE):
                found = document_pairs(known, [data[at[i] : at[i + 1]].tobytes() for i in range(low, high)])
                more, times = np.unique(found, return_counts=True)
                pairs, counts = _summed(np.concatenate([pairs, more]), np.concatenate([counts, times]))
                if len(pairs) > HELD_PAIRS:
                    yield from emitted()
                    pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield from emitted()

    return count


def _level_place(keys: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    spread = mixed(keys.astype(np.uint64) + np.uint64((level + 1) * _STEP % (1 << 64)))
    return (spread % np.asarray(sizes, np.uint64)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one after the other, and the (different) keys in the order of their places.

    A level has two bits a key; keys that fall alone are placed, the others go on to the next level.
    """
    sizes, bits, placed = [], [], []
    while len(keys):
        size = 2 * len(keys)
        at = _level_place(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        done = alone[at]
        placed.append(keys[done][np.argsort(at[done])])
        sizes.append(size)
        bits.append(alone)
        keys = keys[~done]
    return sizes, np.concatenate(bits or [np.empty(0, bool)]), np.concatenate(placed or [np.empty(0, np.int64)])


class Table:
    """Counts of the pairs of some buckets, by their minimal perfect hashes."""

    def __init__(self, buckets: int, rows: list[dict]):
        self.buckets = buckets
        self.keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows] or [np.empty(0, np.int64)])
        self.counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows] or [np.empty(0, np.int64)])
        sizes = [np.array(r["levels"], np.int64) for r in rows]
        self.depth = max(map(len, sizes), default=0)
        #: Per bucket (row of ``slot``) and level: the first bit and the number of bits, 0 where there is no level.
        self.slot = np.full(buckets, -1)
        self.slot[[r["bucket"] for r in rows]] = np.arange(len(rows))
        self.size = np.zeros((len(rows), self.depth), np.int64)
        for i, own in enumerate(sizes):
            self.size[i, : len(own)] = own
        self.first = (np.cumsum(self.size) - self.size.ravel()).reshape(self.size.shape)
        self.bits = np.concatenate(
            [np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: s.sum()] for r, s in zip(rows, sizes)] or [np.empty(0, np.uint8)]
        ).view(bool)
        self.place = np.cumsum(self.bits, dtype=np.int32) - np.int32(1)

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """The place of each pair; -1 for a pair that is not in the table."""
        out = np.full(len(pairs), -1)
        slot = self.slot[_spot(pairs) % self.buckets]
        open_ = np.flatnonzero(slot >= 0)
        for level in range(self.depth):
            size = self.size[slot[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            at = self.first[slot[open_], level] + _level_place(pairs[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.place[at[hit]]
            open_ = open_[~hit]
        # Any pair may hit some bit, so the key decides.
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != pairs[found]]] = -1
        return out


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, cuts in runs(batches, ["bucket"]):
        bucket, pair = table["bucket"].to_numpy(), table["pair"].to_numpy()
        for low, high in zip(cuts, cuts[1:]):
            levels, bits, keys = perfect_hash(np.unique(pair[low:high]))
            row = {"bucket": int(bucket[low]), "size": len(keys), "levels": levels, "bits": np.packbits(bits).tobytes(), "keys": keys.tobytes()}
            yield pa.RecordBatch.from_pylist([row], _HASH)


_HASH = pa.schema(
    [("bucket", pa.int32()), ("size", pa.int64()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())]
)
_VECTOR = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _vector(rows: pa.Table, hashes: pa.Table) -> pa.Table:
    """The dense counts of a bucket's rows of some tasks, in the order of the bucket's hash."""
    if not rows.num_rows:
        return _VECTOR.empty_table()
    (made,) = hashes.to_pylist()
    made = made | {"counts": b"", "bucket": 0}
    table = Table(1, [made])
    counts = np.zeros(made["size"], np.int64)
    np.add.at(counts, table.places(rows["pair"].to_numpy()), rows["docs"].to_numpy())
    row = {"bucket": rows["bucket"][0].as_py(), "part": rows["part"][0].as_py(), "counts": counts.tobytes()}
    return pa.Table.from_pylist([row], _VECTOR)


def _added(rows: pa.Table) -> pa.Table:
    total = np.frombuffer(rows["counts"][0].as_py(), np.int64).copy()
    for i in range(1, rows.num_rows):
        total += np.frombuffer(rows["counts"][i].as_py(), np.int64)
    row = {"bucket": rows["bucket"][0].as_py(), "part": rows["up"][0].as_py(), "counts": total.tobytes()}
    return pa.Table.from_pylist([row], _VECTOR)


def _bests(b_size: int):
    """The highest count of each id of A in each bucket."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                ids = np.frombuffer(keys, np.int64) // b_size
                most = np.zeros(ids.max(initial=-1) + 1, np.int64)
                np.maximum.at(most, ids, np.frombuffer(counts, np.int64))
                held = np.flatnonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(most[held])], names=["a", "most"])

    return best


@dataclass
class Counts:
    """The stored table of pairs: a row per bucket with its hash, keys and counts."""

    table: DataFrame
    buckets: int
    sizes: list[tuple[int, int]]
    best: np.ndarray

    def blocks(self, limit: int) -> list[list[int]]:
        """Buckets in blocks of at most ``limit`` pairs (or of one bucket)."""
        out: list[list[int]] = [[]]
        held = 0
        for bucket, size in self.sizes:
            if out[-1] and held + size > limit:
                out.append([])
                held = 0
            out[-1].append(bucket)
            held += size
        return out


def counted(docs: DataFrame, a_path: str, b_path: str, text: str = "text", bucket_pairs: int = BUCKET_PAIRS) -> Counts:
    """In how many documents each pair of ids is linked."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_counter(a_path, b_path), "task int, spot int, pair long, docs long")
    found = staged(rows, "pair-counts")
    total = found.count()
    buckets = max(1, -(-total // bucket_pairs))
    rows = found.withColumn("bucket", (F.col("spot") % buckets).cast("int"))
    pairs = rows.select("bucket", "pair").repartition("bucket").sortWithinPartitions("bucket")
    hashes = staged(pairs.mapInArrow(_hasher, "bucket int, size long, levels array<long>, bits binary, keys binary"), "pair-hashes")
    sizes = [(r["bucket"], r["size"]) for r in hashes.select("bucket", "size").orderBy("bucket").collect()]
    # As many vectors as tasks' rows fill at least by half, so vectors never outgrow the rows.
    parts = min(64, max(2, total // (2 * max(1, sum(n for _, n in sizes)))))
    dealt = rows.withColumn("part", (F.col("task") % parts).cast("int")).groupBy("bucket", "part")
    copies = hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("bucket", "part")
    shape = "bucket int, part int, counts binary"
    vectors = dealt.cogroup(copies).applyInArrow(_vector, shape)
    while parts > 1:
        up = vectors.withColumn("up", F.expr(f"part div {FAN_IN}").cast("int"))
        vectors = up.groupBy("bucket", "up").applyInArrow(_added, shape)
        parts = -(-parts // FAN_IN)
    table = staged(hashes.join(vectors.drop("part"), "bucket"), "pair-table")
    released(found, hashes)
    known = aligner(a_path, b_path)
    b_size, a_size = known.b_size, len(known.a_bytes)
    # One row for each id of A at most.
    most = table.select("keys", "counts").mapInArrow(_bests(b_size), "a long, most long").groupBy("a").agg(F.max("most").alias("most")).collect()
    best = np.zeros(a_size, np.int64)
    best[[r["a"] for r in most]] = [r["most"] for r in most]
    return Counts(table, buckets, sizes, best)


class _Sums:
    """Per piece, what its links look up in a block: how many have their A id's highest count, and the counts' sum."""

    def __init__(self, buckets: int, rows: list[dict], best: np.ndarray):
        self.table, self.best = Table(buckets, rows), best
        self.generation = 0

    def of(self, known: Aligner) -> tuple[np.ndarray, np.ndarray]:
        if self.generation != known.generation:
            self.generation = known.generation
            self.n_best, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = len(self.total)
        if done < len(known.texts):
            ends = known.ends[done:]
            links = known.links[ends[0] : ends[-1]]
            pairs, at = np.unique(links, return_inverse=True)
            place = self.table.places(pairs)
            count = np.where(place >= 0, self.table.counts[place], 0) if len(self.table.counts) else np.zeros(len(pairs), np.int64)
            highest = (place >= 0) & (count == self.best[pairs // known.b_size])
            for name, values in (("n_best", highest[at]), ("total", count[at])):
                sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends - ends[0]]
                setattr(self, name, np.concatenate([getattr(self, name), np.diff(sums)]))
        return self.n_best, self.total


class _Named:
    """A broadcast block that is told apart by its name."""

    def __init__(self, name: str, shared):
        self.name, self.shared = name, shared

    def sums(self) -> _Sums:
        return _sums_of(self)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Named) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)


@lru_cache(1)
def _sums_of(block: _Named) -> _Sums:
    """The worker's sums under a block, which is unpacked once."""
    return _Sums(*block.shared.value)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _looker(a_path: str, b_path: str, block: _Named, first: bool, keep: bool, digest: bool):
    groups_name = "groups_sha256" if digest else "groups"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        sums = block.sums()
        for whole in batches:
            data, at = text_bytes(whole.column("text"))
            for low, high in slices(at, _SLICE):
                batch = whole.slice(low, high - low)
                numbers, bounds, good = known.numbered([data[at[i] : at[i + 1]].tobytes() for i in range(low, high)])

                def summed(values: np.ndarray) -> np.ndarray:
                    held = np.concatenate([[0], np.cumsum(values[numbers], dtype=np.int64)])
                    return np.where(good, held[bounds[1:]] - held[bounds[:-1]], 0)

                out = {n: batch.column(n) for n in batch.schema.names if keep or n != "text"}
                if first:
                    out |= {name: pa.array(summed(known.counts[k])) for k, name in enumerate(_FIGURES)}
                    flat, texts = numbers.tolist(), known.texts
                    groups = [b";".join([texts[n] for n in flat[i:j]]) if ok else b"" for i, j, ok in zip(bounds, bounds[1:], good)]
                    if digest:
                        groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                    else:
                        groups = [g.decode() for g in groups]
                    out[groups_name] = pa.array(groups, pa.string())
                for name, values in zip(("n_best", "count_sum"), sums.of(known)):
                    more = summed(values)
                    out[name] = pa.array(more if first else more + out[name].to_numpy())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return look


def aligned(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    text: str = "text",
    digest: bool = False,
    block_pairs: int = BLOCK_PAIRS,
    bucket_pairs: int = BUCKET_PAIRS,
) -> DataFrame:
    """``docs`` without the text, with the figures of its alignment; clashing columns are replaced.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``groups``, the ids of A and B in each group
    (``a1,a2|b1;a3|b2``), or ``groups_sha256`` with ``digest``; ``n_best``, links whose count is the highest of
    their A id in the corpus, ties included; ``count_sum``, the sum of the links' counts. The count of a
    pair of ids is the number of rows that hold it linked, so repeated rows count each.

    A null or empty text, and one whose tokens of A or B do not spell a space and the text, has no tokens:
    zeros and an empty text. Whole texts are read, whatever their length. An empty table gives an empty result.
    """
    counts = counted(docs, a_path, b_path, text, bucket_pairs)
    groups = "groups_sha256" if digest else "groups"
    made = [*_FIGURES, groups, "n_best", "count_sum"]
    kept = [c for c in docs.columns if c not in made and c != text]
    rows = docs.select(*[F.col(c).alias(f"kept_{c}") for c in kept], F.col(text).alias("text"))
    blocks = counts.blocks(block_pairs)
    for n, block in enumerate(blocks):
        last = n == len(blocks) - 1
        held = counts.table.where(F.col("bucket").between(block[0], block[-1])) if block else counts.table.limit(0)
        value = (counts.buckets, held.toArrow().to_pylist(), counts.best)
        shared = _Named(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(value))
        names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if not (last and f.name == "text")]
        if n == 0:
            names += [f"{c} {'string' if c == groups else 'long'}" for c in made]
        rows = rows.mapInArrow(_looker(a_path, b_path, shared, n == 0, not last, digest), ", ".join(names))
        if not last:
            rows = staged(rows, "aligned")
    return rows.select(*[F.col(f"kept_{c}").alias(c) for c in kept], *made)


def op11_cross_tokenizer_alignment(spark, folder: str) -> DataFrame:
    """All documents, aligned between a byte-level and a sentencepiece vocabulary."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return aligned(docs, *paths, digest=True)
