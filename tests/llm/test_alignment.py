"""The alignment against whole-text tokenisation and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from signalsift.llm import alignment as al

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "x\n\n\ny z", "tab\tand\r\nline", "it's 'quoted' 's",
    "<|endoftext|> </s> <unk> <0x0A>", "▁ literal ▁", "日本語の文章 です", "café naïve ÀÉ", "１２ ﬁ", " nbsp  x　y", "emoji 👩‍👩‍👧 ok",
    "é comb", "... --- !!!", "1234567890 42", "\x00 null \x1f", "a b  c", "Ω≈ç√ ∫", "word " * 3000, "b" * 3000, "¿qué? ¡sí!", " \n\n  \t x", "end\n", "x\u00a0 y\u00a0 z\u0085 w", "end.of:a;word!? x.y.z é. É, 👩. 1.5 (a).b", ".", ". a", "a.", "\n.", "a\u3000 b\u2003 c",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = al.byte_letters()
    entries = {n: bytes(letters[c] for c in e) for e, n in a.get_vocab(with_added_tokens=False).items()}

    def spelled(i):
        e = b.id_to_piece(i)
        return bytes([int(e[3:5], 16)]) if b.is_byte(i) else e.replace("▁", " ").encode()

    def tokens(text):
        whole = (" " + text).encode()
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xs, ys = [entries[i] for i in x], [spelled(i) for i in y]
        return (x, xs, y, ys) if text and b"".join(xs) == whole == b"".join(ys) else ([], [], [], [])

    return tokens


def ends(parts):
    return np.cumsum([len(p) for p in parts]).tolist()


def expected(rows, tokens):
    """Contract rows of (doc_id, text)."""
    links, groups, sizes = [], [], []
    for _, text in rows:
        x, xs, y, ys = tokens(text or "")
        ea, eb = ends(xs), ends(ys)
        j, own = 0, []
        for i, id_a in enumerate(x):
            low = ea[i] - len(xs[i])
            while j < len(y) and eb[j] <= low:
                j += 1
            k = j
            while k < len(y) and eb[k] - len(ys[k]) < ea[i]:
                own.append((id_a, y[k]))
                k += 1
        links.append(own)
        cuts = sorted(set(ea) & set(eb))
        told, p, q = [], 0, 0
        for cut in cuts:
            p2, q2 = ea.index(cut, p) + 1, eb.index(cut, q) + 1
            told.append(",".join(map(str, x[p:p2])) + "|" + ",".join(map(str, y[q:q2])))
            p, q = p2, q2
        groups.append(";".join(told))
        sizes.append((len(x), len(y), len(cuts), len(own)))
    count = Counter(pair for own in links for pair in set(own))
    best = defaultdict(int)
    for (id_a, _), n in count.items():
        best[id_a] = max(best[id_a], n)
    return sorted(
        (
            (doc, *size, told, sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own))
            for (doc, _), size, told, own in zip(rows, sizes, groups, links)
        ),
        key=str,
    )


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, al.aligned(df, A, B, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = [(r["doc_id"], r["text"]) for r in table][:60]
    random.seed(5)
    alphabet = ["a", "b", "the", "  ", " ", " ", "\n", "\t", "é", "日", "1", "'s", "<", "▁", " ", "ing", ".", "-", ",", "!"]
    docs += [(10_000 + i, "".join(random.choices(alphabet, k=random.randint(1, 40)))) for i in range(400)]
    return docs + [(20_000 + i, t) for i, t in enumerate(ODD)] + [(1, "twice the same"), (1, "twice the same"), (None, "no id")]


def test_equal_to_whole_texts(spark, rows, plain):
    assert found(spark, rows) == expected(rows, plain)


def test_many_buckets_and_blocks(spark, rows, plain):
    assert found(spark, rows, bucket_pairs=300, block_pairs=1500) == expected(rows, plain)


def test_forgetful_workers(spark, rows, plain, monkeypatch):
    known = al.Aligner(A, B)
    monkeypatch.setattr(al, "CACHE_PIECES", 50)
    texts = [(t or "").encode() for _, t in rows]
    at, sizes = 0, expected(rows, plain)
    by_text = {}
    for i in range(0, len(texts), 7):
        numbers, bounds, good = known.numbered(texts[i : i + 7])
        for k, t in enumerate(texts[i : i + 7]):
            own = numbers[bounds[k] : bounds[k + 1]]
            by_text[t] = int(known.counts[0, own].sum()) if good[k] else 0
    want = {(t or "").encode(): len(plain(t or "")[0]) for _, t in rows}
    assert by_text == want


def test_contract_columns_and_clashes(spark, plain, tmp_path):
    docs = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = al.op11_cross_tokenizer_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    want = {r[0]: (r[1:5], hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "", r[6:]) for r in expected(docs, plain)}
    assert {r[0]: (tuple(r[1:5]), r[5], tuple(r[6:])) for r in got.collect()} == want
    clash = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id int, text string, groups string, kept_n int")
    out = al.aligned(clash, A, B)
    assert out.columns == ["doc_id", "kept_n", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert out.first()["kept_n"] == 5


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 0, 0, 0, "", 0, 0)]


def test_perfect_hash_places_every_key_once():
    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 40, 5000))
    rows = []
    for bucket in range(3):
        own = keys[al._spot(keys) % 3 == bucket]
        levels, bits, placed = al.perfect_hash(own)
        assert sorted(placed) == sorted(own) and bits.sum() == len(own)
        rows.append({"bucket": bucket, "size": len(own), "levels": levels, "bits": np.packbits(bits).tobytes(), "keys": placed.tobytes(), "counts": placed.tobytes()})
    table = al.Table(3, rows)
    assert sorted(table.places(keys)) == list(range(len(keys)))
    assert (table.counts[table.places(keys)] == keys).all()
    others = np.setdiff1d(np.random.default_rng(5).integers(0, 1 << 40, 5000), keys)
    assert (table.places(others) == -1).all()
    assert (al.Table(3, rows[:1]).places(keys) >= 0).sum() == rows[0]["size"]


def test_one_very_long_word(spark):
    (row,) = found(spark, [(1, "x" * 300_000 + " " + "é日" * 20_000)])
    assert row[1] > 0 and row[4] >= max(row[1], row[2])
