"""Language of a text by cross-parsing entropy against suffix automata.

Each language has a text to learn from. Its suffix automaton accepts every
substring, so the longest match at any place of another text is a walk from the
automaton's start until no edge is left. A text is parsed greedily into such
phrases; the fewer phrases, the better the language predicts it. The cost is
``phrases * log2(length of the language's text) / length``, the Ziv-Merhav estimate of
the cross entropy in bits per byte, and the language with the least cost wins.

Texts are read as letters: lower case, all other characters as one space, UTF-8
bytes as symbols. A batch is parsed by numpy, one step of all its stretches at a
time, so Python does no work per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalsift.llm.batches import slices, text_bytes

#: What a language learns from at most: so many documents, those with the smallest hash, of each a stretch
#: of so many characters at a place given by the hash, and so many bytes together.
TRAINING_DOCUMENTS, TRAINING_STRETCH, TRAINING_BYTES = 200, 600, 60_000
#: Bytes parsed at once; a longer text is parsed in stretches, at whose ends a phrase ends.
STRETCH = 2048
_SLICE = 4 << 20
UNKNOWN = "und"


def letters(texts: pa.Array) -> pa.Array:
    """Lower case, with one space for every run of other characters, and one at both ends."""
    texts = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pM]+", " ")
    return pc.binary_join_element_wise("", pc.utf8_trim(texts, " "), "", " ")


class Automaton:
    """The suffix automaton of a text, as edges in the order of their states."""

    def __init__(self, text: bytes):
        edges: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for symbol in text:
            now = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in edges[at]:
                edges[at][symbol] = now
                at = link[at]
            if at >= 0:
                met = edges[at][symbol]
                if length[at] + 1 == length[met]:
                    link[now] = met
                else:
                    copy = len(edges)
                    edges.append(dict(edges[met]))
                    length.append(length[at] + 1)
                    link.append(link[met])
                    while at >= 0 and edges[at].get(symbol) == met:
                        edges[at][symbol] = copy
                        at = link[at]
                    link[met] = link[now] = copy
            last = now
        self.size = len(text)
        self.states = len(edges)
        total = sum(map(len, edges))
        self.source = np.repeat(np.arange(self.states, dtype=np.int32), [len(e) for e in edges])
        self.symbol = np.fromiter((s for e in edges for s in e), np.uint8, total)
        self.target = np.fromiter((t for e in edges for t in e.values()), np.int32, total)

    def table(self, places: np.ndarray, width: int) -> np.ndarray:
        """Targets by state and symbol place, 0 where there is no edge (no edge leads to the start)."""
        out = np.zeros(self.states * width, np.int32)
        out[self.source.astype(np.int64) * width + places[self.symbol]] = self.target * np.int32(width)
        return out


@dataclass
class Model:
    """The automata of the languages."""

    langs: list[str]
    automata: list[Automaton]

    def __post_init__(self) -> None:
        seen = np.unique(np.concatenate([a.symbol for a in self.automata])) if self.automata else np.empty(0, np.uint8)
        self.width = len(seen) + 1
        #: Place of each byte in a table; 0 for bytes that no language has.
        self.places = np.zeros(256, np.int32)
        self.places[seen] = np.arange(1, len(seen) + 1)

    def phrases(self, automaton: Automaton, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of phrases of each stretch of ``data`` (places of symbols); the stretches' lengths fall."""
        table = automaton.table(self.places, self.width)
        found = np.ones(len(starts), np.int32)
        state = np.zeros(len(starts), np.int32)
        at = starts.copy()
        left = len(starts)
        ends = np.searchsorted(-lengths, -np.arange(lengths[0] if left else 0), "left")
        for left in ends:
            now = state[:left]
            symbol = data[at[:left]]
            step = table[now + symbol]
            # No edge: the phrase has ended before this symbol, which starts the next one.
            stuck = np.flatnonzero(step == 0)
            if len(stuck):
                found[stuck] += now[stuck] > 0
                step[stuck] = again = table[symbol[stuck]]
                # A symbol that the language does not have is a phrase by itself.
                lost = stuck[again == 0]
                found[lost] += 1
            state[:left] = step
            at[:left] += 1
        # A stretch that ends at the start of the automaton has no open phrase.
        return found - (state == 0)

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits per byte of each text under each language; 0 for a text of no bytes."""
        sizes = np.diff(offsets)
        parts = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = offsets[text] + number * STRETCH
        lengths = np.minimum(offsets[text + 1] - starts, STRETCH)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, text = starts[order], lengths[order], text[order]
        symbols = self.places[data]
        out = np.zeros((len(sizes), len(self.langs)))
        for k, automaton in enumerate(self.automata):
            count = np.bincount(text, self.phrases(automaton, symbols, starts, lengths), len(sizes))
            out[:, k] = count * np.log2(max(automaton.size, 2)) / np.maximum(sizes, 1)
        return out


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Automata from a bounded sample of the rows that have a language and letters.

    The bounds are ``TRAINING_DOCUMENTS`` rows of each language, ``TRAINING_STRETCH`` characters
    of each and ``TRAINING_BYTES`` together. Which rows those are depends on their
    ids and texts alone.
    """
    spot = F.xxhash64(F.col(doc_id).cast("string"), F.length(text))
    start = F.pmod(spot, F.greatest(F.length(text) - TRAINING_STRETCH + 1, F.lit(1))) + 1
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), spot.alias("spot"), F.substr(F.col(text), start.cast("int"), F.lit(TRAINING_STRETCH)).alias("stretch"))
    # Spark keeps the first rows of each task before the shuffle.
    order = Window.partitionBy("lang").orderBy("spot", "stretch")
    chosen = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRAINING_DOCUMENTS)
    held: dict[str, list[str]] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["place"])):
        held.setdefault(row["lang"], []).append(row["stretch"])
    langs, automata = [], []
    for name, stretches in held.items():
        joined = "".join(letters(pa.array(stretches, pa.string())).to_pylist()).encode()[:TRAINING_BYTES]
        if joined.strip():
            langs.append(name)
            automata.append(Automaton(joined))
    return Model(langs, automata)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("text")
            _, at = text_bytes(texts)
            for low, high in slices(at, _SLICE):
                part = pc.fill_null(texts.slice(low, high - low), "")
                data, offsets = text_bytes(letters(part))
                said = pc.match_substring_regex(part, r"\pL").to_numpy(zero_copy_only=False)
                best = np.full(high - low, len(model.langs))
                score = np.zeros(high - low)
                if model.langs:
                    costs = model.costs(data, offsets)
                    best = np.where(said, costs.argmin(axis=1), best)
                    least = costs.min(axis=1)
                    # Likeness of the languages at the costs of some bytes; one language alone is certain.
                    share = np.exp2(4 * (least[:, None] - costs)).sum(axis=1)
                    score = np.where(said, 1 / share, 0.0)
                kept = [batch.column(n).slice(low, high - low) for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(names[best], pa.string()), pa.array(score)],
                    names=[*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"],
                )

    return score


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred`` and ``score`` (0 to 1); clashing columns are replaced.

    Whole texts are read, whatever their length. A null text, one without a letter, and
    every text under a model without languages, is ``und`` with score 0. Equal costs
    go to the language that comes first by name. Repeated rows have equal results, an
    empty table an empty one. Every row comes back once; there is no shuffle.
    """
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*[F.col(c).alias(f"kept_{c}") for c in kept], F.col(text).cast("string").alias("text"))
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scorer(shared), f"{shape}lang_pred string, score double")
    return out.select(*[F.col(f"kept_{c}").alias(c) for c in kept], "lang_pred", "score")


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document's language is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op12_language_id(spark, folder: str) -> DataFrame:
    """All documents, by automata of those that are not held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    model = fitted(docs.where(~held_out(F.col("doc_id"))))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
