"""Toxic documents by a string-kernel support vector machine with Nystroem landmarks.

The kernel counts subsequences of three characters, with gaps: each occurrence
weighs ``DECAY`` for every character it skips, so that an insult with inserted or
changed characters stays close to the plain one. It is normalised and works on
units: the words of a text, without what is not a letter or a digit between letters;
letters that stand alone (``i d i o t``) are joined first, long words are
read in overlapping pieces; neighbouring words are joined too where what stands
on both sides of the gap stands together in a telling unit (``idi ot``).
Landmarks are units of labelled sentences; the kernel values with them, whitened
by the landmarks' own kernel matrix, are the features of a linear machine, trained
with the squared hinge loss.

Labels belong to documents, of which a toxic one holds at least one toxic
sentence. So the units that are much more frequent in toxic documents stand for
them, and in rounds the units of clean documents that look most toxic to the
machine become its counter-examples. Copies of the telling units with one or two
characters more inside are examples too, and the more telling a unit is, the
larger the margin asked for. A document's score is that of its most toxic
unit, turned into a probability by a logistic curve fitted on the same documents.

With the landmarks fixed, the machine is one weight for each subsequence, so a unit
costs the same with any number of landmarks, and each different word is scored once
in a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.llm.batches import handed_back, slices, sole_cache, text_bytes

#: Labelled documents that training reads at most, of each label: those with the smallest hash.
TRAINING_TOXIC, TRAINING_CLEAN = 1000, 2000
LANDMARKS = 768
ROUNDS = 4
DECAY = 0.7
#: Weight of each class in the machine, against a ridge of 1.
COST = 5000.0
#: Weight of the varied units against the plain ones.
VARIED = 2.0
#: Weight of the varied units against the toxic documents in the logistic curve.
MISSPELT = 0.5
#: Log odds of a witness that ask for a margin of 1; larger ones ask for more in proportion.
EVIDENCE = 2.0
#: Words meet by chance too, so only witnesses with this share of the largest log odds are looked for across gaps.
SURE = 0.8
UNIT = 20
CACHE_WORDS = 600_000
_SLICE = 2 << 20
#: Subsequences that are projected together.
_BLOCK = 2048
#: Distances of the second and third character from the one before.
_STEPS = [(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a + b <= 5]
_SYMBOLS = 32
_END, _START = 30, 31
#: Characters written for letters (fixed values).
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_JOINED = re.compile(r"(?<![^\W_])(?:[^\W_][\W_]{1,3}){2,}[^\W_](?![^\W_])")
_LOOKS = re.compile("(?<=[^\\W\\d_])[%s](?=[^\\W\\d_])" % re.escape("".join(LOOKALIKES)))


def _code(char: str) -> int:
    """1 to 26 for a to z, 27 to 29 for other letters and digits, 0 for all else."""
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) % 3 if char.isalnum() else 0


class _Codes(dict):
    def __missing__(self, char: str) -> int:
        self[char] = code = _code(char)
        return code


_CODES = _Codes()


def units_of(word: str) -> list[bytes]:
    """The units of a word: its letters' codes between a start and an end mark, long ones in overlapping pieces."""
    word = _LOOKS.sub(lambda m: LOOKALIKES[m[0]], word.lower())
    codes = [c for c in map(_CODES.__getitem__, word) if c]
    if len(codes) < 3:
        return []
    codes = bytes([_START, *codes, _END])
    if len(codes) <= UNIT:
        return [codes]
    return [codes[i : i + UNIT] for i in range(0, len(codes) - UNIT // 2, UNIT // 2)]


def _ends(word: str) -> tuple[int, int]:
    """The first and the last two characters of a word with its marks, as numbers; 0 if it can be no part of a unit."""
    codes = [c for c in map(_CODES.__getitem__, _LOOKS.sub(lambda m: LOOKALIKES[m[0]], word.lower())) if c]
    if not 1 <= len(codes) <= UNIT - 3:
        return 0, 0
    first, last = [*codes[:2], _END][:2], [_START, *codes][-2:]
    return first[0] * _SYMBOLS + first[1], last[0] * _SYMBOLS + last[1]


def _words(text: str) -> list[str]:
    """Words between white space; runs of letters that stand alone are one word more."""
    found = text.split()
    for run in _JOINED.finditer(text) if any(len(w) < 3 for w in found) else ():
        found.append(re.sub(r"[\W_]+", "", run[0]))
    return found


def features(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of all units: unit, number of the subsequence, weight; repeats summed, each unit of length 1."""
    n = len(units)
    lengths = np.fromiter(map(len, units), np.int64, n)
    held = np.zeros((n, UNIT + 6), np.int64)
    held[np.arange(UNIT + 6)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(units), np.uint8)
    rows, keys, weights = [], [], []
    for a, b in _STEPS:
        key = (held[:, :UNIT] * _SYMBOLS + held[:, a : UNIT + a]) * _SYMBOLS + held[:, a + b : UNIT + a + b]
        row, col = np.nonzero(held[:, a + b : UNIT + a + b])
        rows.append(row)
        keys.append(key[row, col])
        weights.append(np.full(len(row), DECAY ** (a + b - 2)))
    joint = np.concatenate(rows) * _SYMBOLS**3 + np.concatenate(keys)
    order = np.argsort(joint, kind="stable")
    joint, weight = joint[order], np.concatenate(weights)[order]
    first = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.empty(0, np.int64)
    weight = np.add.reduceat(weight, first) if len(first) else weight
    row, key = joint[first] // _SYMBOLS**3, joint[first] % _SYMBOLS**3
    norm = np.sqrt(np.bincount(row, weight**2, n))
    return row, key, weight / norm[row]


class _Known:
    """The subsequences of many units, kept small: 16-bit numbers and 32-bit weights."""

    CHUNK = 10_000

    def __init__(self, units: list[bytes]):
        keys, weights, sizes = [], [], []
        for at in range(0, len(units), self.CHUNK):
            part = units[at : at + self.CHUNK]
            row, key, weight = features(part)
            keys.append(key.astype(np.uint16))
            weights.append(weight.astype(np.float32))
            sizes.append(np.bincount(row, minlength=len(part)))
        self.key, self.weight = np.concatenate(keys), np.concatenate(weights)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def dense(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((len(chosen), _SYMBOLS**3), np.float32)
        for i, u in enumerate(chosen):
            place = slice(self.starts[u], self.starts[u + 1])
            out[i, self.key[place]] = self.weight[place]
        return out

    def scored(self, table: np.ndarray) -> np.ndarray:
        """The sum of a table's entries over each unit's subsequences (each unit has some)."""
        out = []
        for at in range(0, len(self.starts) - 1, self.CHUNK):
            starts = self.starts[at : at + self.CHUNK + 1]
            place = slice(starts[0], starts[-1])
            out.append(np.add.reduceat(self.weight[place] * table[self.key[place]], starts[:-1] - starts[0]))
        return np.concatenate(out)


def varied(unit: bytes, random: np.random.Generator) -> list[bytes]:
    """The unit with one letter more, a repeated one and two letters more, at each place inside."""
    out = []
    for i in range(2, len(unit) - 1):
        one, two, three = (int(c) for c in random.integers(1, 27, 3))
        out += [bytes((*unit[:i], *more, *unit[i:]))[:UNIT] for more in ((one,), (unit[i - 1],), (two, three))]
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, need: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge loss, by Newton's method.

    ``need`` is the margin from which on an example has no loss.
    """
    w = np.zeros(x.shape[1] + 1)
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        curve, pull = np.diag(keep), np.zeros(len(w))
        for at in range(0, len(x), 2000):
            part = slice(at, at + 2000)
            xa = np.hstack([x[part], np.ones((len(x[part]), 1))])
            active = y[part] * (xa @ w) < need[part]
            xa, ca = xa[active], cost[part][active]
            weighed = (xa * ca[:, None]).T
            curve += weighed @ xa
            pull += weighed @ (y * need)[part][active]
        new = np.linalg.solve(curve, pull)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


@dataclass
class Model:
    """Weights of subsequences, offset, slope and offset of the logistic curve; what stands together in sure witnesses."""

    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    name: str = ""
    inside: np.ndarray = field(default_factory=lambda: _inside(()))

    def margins(self, units: list[bytes]) -> np.ndarray:
        if not units:
            return np.empty(0)
        row, key, weight = features(units)
        return np.bincount(row, weight * self.weights[key], len(units)) + self.offset

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))

    def word_margins(self, words: list[str], counts: np.ndarray | None = None) -> np.ndarray:
        """The margin of each word, its most toxic unit's; one without units has that of nothing said.

        With ``counts``, the words of each text, a word also takes the margin of itself joined with the
        next one of its text, if the characters on both sides of the gap stand together in a sure witness.
        """
        known = _known(self.name)
        numbers = known.numbers(self, words)
        margins = known.margin[numbers]
        if counts is None or len(words) < 2:
            return margins
        near = self.inside[known.last[numbers[:-1]], known.first[numbers[1:]]]
        ends = np.cumsum(counts)[:-1]
        near[ends[(ends > 0) & (ends < len(words))] - 1] = False
        at = np.flatnonzero(near)
        if len(at):
            joined = known.numbers(self, [words[i] + words[i + 1] for i in at])
            margins[at] = np.maximum(margins[at], known.margin[joined])
        return margins

    @cached_property
    def lowest(self) -> float:
        return self.offset - float(np.abs(self.weights).max() + 1)


class _Lexicon:
    """A worker's words under a model: margins and ends, by number."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.margin, self.first, self.last = np.empty(0), np.empty(0, np.int16), np.empty(0, np.int16)

    def numbers(self, model: Model, words: list[str]) -> np.ndarray:
        if len(self.number) > CACHE_WORDS:
            self.clear()
        get = self.number.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        new = list(dict.fromkeys(words[i] for i in missing))
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            units = [units_of(w) for w in part]
            margins = model.margins([u for us in units for u in us])
            at, told = 0, []
            for us in units:
                told.append(max(margins[at : at + len(us)].tolist(), default=model.lowest))
                at += len(us)
            first, last = zip(*map(_ends, part))
            self.number.update(zip(part, range(len(self.margin), len(self.margin) + len(part))))
            self.margin = np.concatenate([self.margin, told])
            self.first = np.concatenate([self.first, np.array(first, np.int16)])
            self.last = np.concatenate([self.last, np.array(last, np.int16)])
        for i in missing:
            found[i] = self.number[words[i]]
        return found


@lru_cache(1)
def _known(name: str) -> _Lexicon:
    """A worker's words under the model of this name."""
    return _Lexicon()


def _inside(units: Iterable[bytes]) -> np.ndarray:
    """Which two characters with which two behind them stand in one of the units, marks included."""
    out = np.zeros((_SYMBOLS**2, _SYMBOLS**2), bool)
    for unit in units:
        for i in range(len(unit) - 3):
            a, b, c, d = unit[i : i + 4]
            out[a * _SYMBOLS + b, c * _SYMBOLS + d] = True
    return out


def trained(bags: Iterable[tuple[int, list[str]]], prior: float) -> Model:
    """A model from labelled documents, given as label and different words."""
    of_word: dict[str, list[int]] = {}
    number: dict[bytes, int] = {}
    held: list[np.ndarray] = []
    told: list[int] = []
    for label, words in bags:
        told.append(label)
        own: set[int] = set()
        for word in words:
            ids = of_word.get(word)
            if ids is None:
                ids = of_word[word] = [number.setdefault(u, len(number)) for u in units_of(word)]
            own.update(ids)
        held.append(np.fromiter(own, np.int32, len(own)))
    labels = np.array(told, np.int64)
    units = list(number)
    del of_word, number
    empty = Model(np.zeros(_SYMBOLS**3), -1.0, name="empty")
    if not units or labels.min(initial=1) == labels.max(initial=0):
        empty.shift = 1 + np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return empty
    bag = np.repeat(np.arange(len(held)), [len(h) for h in held])
    unit = np.concatenate(held)
    # How often a unit is in documents of each label. Near copies have the same first unit in a random
    # order as a rule, so of the toxic ones those with different first units are counted.
    mark = np.random.default_rng(7).permutation(len(units))
    first = np.full(len(held), -1, np.int64)
    np.maximum.at(first, bag, mark[unit])
    pairs = np.unique(np.stack([unit, first[bag]])[:, labels[bag] == 1], axis=1)
    toxic = np.bincount(pairs[0], minlength=len(units))
    clean = np.bincount(unit[labels[bag] == 0], minlength=len(units))
    n_toxic, n_clean = len(np.unique(first[labels == 1])), int((labels == 0).sum())
    strength = toxic / n_toxic - 3 * clean / n_clean
    # What says more of a label must be further from the other side.
    odds = np.maximum(1, np.log((toxic + 0.5) * n_clean / ((clean + 0.5) * n_toxic)) / EVIDENCE)
    # The units that stand for toxicity: in several toxic documents, and ten times as often as in clean ones.
    witness = np.flatnonzero((toxic >= max(3, 0.01 * n_toxic)) & (clean * n_toxic * 10 <= toxic * n_clean))
    if not len(witness):
        witness = np.flatnonzero(strength == strength.max())
    best = np.lexsort((np.arange(len(units)), -strength))
    landmarks = best[: LANDMARKS // 2]
    common = np.lexsort((np.arange(len(units)), -clean))
    landmarks = np.unique(np.concatenate([landmarks, common[: LANDMARKS - len(landmarks)]]))
    known = _Known(units)
    dense = known.dense
    basis = dense(landmarks)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-5 * values.max()
    whiten = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    project = basis.T @ whiten  # features of a unit: its subsequences times this

    del basis, values, vectors

    def table(w: np.ndarray) -> np.ndarray:
        # In blocks, as all of the projection in double precision takes 200 MB.
        return np.concatenate([project[i : i + _BLOCK] @ w[:-1] for i in range(0, len(project), _BLOCK)])

    def scored(w: np.ndarray) -> np.ndarray:
        return known.scored(table(w)) + w[-1]

    # Inserted and repeated characters are learned from varied witnesses.
    random = np.random.default_rng(11)
    variants = [(v, toxic[u], odds[u]) for u in witness for v in varied(units[u], random)]
    variant_row, variant_key, variant_weight = features([v for v, *_ in variants])
    varied_x = np.zeros((len(variants), project.shape[1]), np.float32)
    edges = np.searchsorted(variant_row, np.arange(len(variants) + 1))
    for i, (start, stop) in enumerate(zip(edges[:-1], edges[1:])):
        varied_x[i] = variant_weight[start:stop] @ project[variant_key[start:stop]]
    variant_cost = np.array([t for _, t, _ in variants], np.float64)
    variant_need = np.array([o for *_, o in variants], np.float64)
    scores = strength
    hard = common[:2000]
    for _ in range(ROUNDS):
        order = np.argsort(scores[unit], kind="stable")
        worst = np.full(len(held), -1, np.int64)
        worst[bag[order]] = unit[order]
        hard = np.unique(np.concatenate([hard, worst[(labels == 0) & (worst >= 0)]]))
        against = hard[~np.isin(hard, witness)]
        picked = np.concatenate([witness, against])
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(against)), np.ones(len(variants))])
        shares = [toxic[witness] / toxic[witness].sum(), np.full(len(against), 1 / max(1, len(against)))]
        cost = COST * np.concatenate([*shares, VARIED * variant_cost / max(1.0, variant_cost.sum())])
        parts = [dense(picked[i : i + 200]) @ project for i in range(0, len(picked), 200)]
        x = np.vstack([*parts, varied_x])
        w = svm(x, y, cost, np.concatenate([odds[witness], np.ones(len(against)), variant_need]))
        scores = scored(w)
    model = Model(table(w).astype(np.float64), float(w[-1]), inside=_inside(units[u] for u in witness if odds[u] >= SURE * odds[witness].max()))
    top = np.full(len(held), model.lowest)
    np.maximum.at(top, bag, scores[unit])
    balance = np.where(labels == 1, prior / max(labels.mean(), 1e-9), (1 - prior) / max(1 - labels.mean(), 1e-9))
    # Varied witnesses are toxic texts too, so that the curve's middle lies below them.
    told, weight = np.ones(len(variants)), MISSPELT * (labels * balance).sum() * variant_cost / max(1.0, variant_cost.sum())
    margins = np.concatenate([top, varied_x @ w[:-1] + w[-1]])
    model.slope, model.shift = _logistic(np.clip(margins, -5, 5), np.concatenate([labels, told]), np.concatenate([balance, weight]))
    model.name = f"{hash((model.weights.tobytes(), model.slope, model.shift)):x}"
    return model


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    design = np.stack([x, np.ones(len(x))], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        slope = design.T @ (cost * (target - p)) - 1e-3 * b
        curve = (design * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        b += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return float(b[0]), float(b[1])


def _made_room() -> None:
    """Before training: let go of what the worker knows from other operators and earlier models."""
    sole_cache("training", lambda: None)


def _bagger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _made_room()
    for batch in batches:
        words = [sorted(set(_words(t or ""))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["id", "toxic", "words"]
        )


def _trainer(prior: float):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _made_room()
        rows = ((b["toxic"][i].as_py(), b["words"][i].as_py()) for b in batches for i in range(b.num_rows))
        m = trained(rows, prior)
        row = {"weights": m.weights.tobytes(), "offset": float(m.offset), "slope": float(m.slope), "shift": float(m.shift), "name": m.name}
        row["inside"] = np.packbits(m.inside).tobytes()
        handed_back()
        yield pa.RecordBatch.from_pylist([row])

    return train


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model from labelled documents; at most ``TRAINING_TOXIC`` and ``TRAINING_CLEAN`` of them, chosen by hash.

    Null labels and ids are left out. With one label only, or no units, the model
    gives every text the share of toxic labels.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(toxic).cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    counts = known.groupBy("toxic").agg(F.count("*").alias("n"))
    counts = {r["toxic"]: r["n"] for r in counts.collect()}
    order = F.xxhash64("id")
    chosen = [known.where(F.col("toxic") == y).orderBy(order, "id").limit(n) for y, n in ((1, TRAINING_TOXIC), (0, TRAINING_CLEAN))]
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    bags = rows.join(chosen[0].unionByName(chosen[1]), "id").select("id", "toxic", "text")
    bags = bags.mapInArrow(_bagger, "id long, toxic int, words array<string>")
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    # The sample has a bound, so one task trains on it; the driver sees the weights.
    bags = bags.repartition(1).sortWithinPartitions("id", "toxic", "words")
    made = bags.mapInArrow(_trainer(prior), "weights binary, offset double, slope double, shift double, name string, inside binary").first()
    # Without a labelled document there may be no task at all.
    if not made:
        return trained([], prior)
    inside = np.unpackbits(np.frombuffer(made["inside"], np.uint8)).astype(bool).reshape(_SYMBOLS**2, _SYMBOLS**2)
    return Model(np.frombuffer(made["weights"]), *made[1:5], inside)


def _scorer(shared, keep: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        sole_cache("toxicity", _known.cache_clear)
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            top = np.full(batch.num_rows, model.lowest)
            for start, stop in slices(at, _SLICE):
                found = [_words(data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(start, stop)]
                counts = np.array([len(f) for f in found])
                margins = model.word_margins([w for f in found for w in f], counts)
                some = np.flatnonzero(counts)
                if len(some):
                    first = np.concatenate([[0], np.cumsum(counts[some])])[:-1]
                    top[start + some] = np.maximum.reduceat(margins, first)
            names = [n for n in batch.schema.names if keep or n != "text"]
            scores = model.probability(np.clip(top, -5, 5))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(scores)], names=[*names, "score"])

    return score


def marked(docs: DataFrame, model: Model, text: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with a ``score``, the probability of being toxic, and with the text only if ``keep``; a clashing column is replaced.

    Whole texts are read. A null text is an empty one; a text without units has
    the score of nothing said. Every row comes back once, in any order; there is no shuffle.
    """
    kept = [c for c in docs.columns if c not in (text, "score")]
    rows = docs.select(*[F.col(c).alias(f"kept_{c}") for c in kept], F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if keep or f.name != "text")
    out = rows.mapInArrow(_scorer(shared, keep), f"{shape}score double")
    names = {f"kept_{c}": c for c in kept} | {"text": text}
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns])


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document's label is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op4_toxicity(spark, folder: str) -> DataFrame:
    """All documents scored by a model of the labels that are not held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    model = fitted(docs, labels.where(~held_out(F.col("doc_id"))))
    out = marked(docs, model, keep=False).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
