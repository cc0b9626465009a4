"""The operators against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalsift.llm import chat, contamination, extraction, jaccard, packing, secrets, shards, toxicity, urls, vectors
from signalsift.llm.components import components
from signalsift.session import ensure_checkpoint_dir, staged, swept

DOCS = "doc_id long, text string, lang string, n int, size string, score string, findings string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


def edited(text: str, seed: int, times: int) -> str:
    r = random.Random(seed)
    out = text.split()
    for _ in range(times):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    """Plain texts, copies, near copies with one to many edits, a common line in most, short, empty, null, long ones."""
    line = " ".join(words(1, 12))
    out: list[str | None] = [" ".join(words(k, 60 + k)) + "\n" + line for k in range(10, 50)]
    out += [out[0]] * 3 + [edited(out[k % 5], k, 1 + k % 6) for k in range(60)]
    out += [edited(out[7], k, 1) for k in range(70)]
    out += [line, line + " x", "one", "one", "two words", "Two WORDS", "", None, "  \n", " ".join(words(5, 30_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1, "s", "s", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[0], None, None, None, None, None)], DOCS).repartition(5)


def brute_components(sets: dict[int, set], fits) -> dict[int, int]:
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and fits(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size,percent,frequent", [(3, 90, 40), (5, 80, 40), (3, 90, 3), (2, 50, 5)])
def test_jaccard(docs, texts, size, percent, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = brute_components(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b))
    got = jaccard.joined(docs, jaccard.Similarity(size, percent)).collect()
    assert len(got) == len(texts) + 1
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == {i: (len(sets[i]), want[i]) for i in sets}
    assert [r[2] for r in got if r[0] is None] == [None]


def test_jaccard_empty(docs):
    assert jaccard.joined(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_known(spark, size, percent):
    like = jaccard.Similarity(size, percent)
    rows = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(n))) for n in range(1, 120)], "id long, text string")
    sketches = rows.mapInArrow(jaccard._sketcher(like), jaccard.SKETCH)
    assert sketches.where(F.size("firsts") != F.least(like.known_of(F.col("n")), F.col("n"))).count() == 0


def test_jaccard_disk(spark, monkeypatch):
    """A step leaves no shuffle files to the next one, even if the driver's collector never runs, and first shingles are not stored again and again."""
    line = " ".join(words(1, 12))
    rows = [(k, " ".join(words(k, 1500)) + " " + line) for k in range(300)]
    rows += [(1000 + k, edited(rows[k][1], k, 3)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = Path(urlparse(ensure_checkpoint_dir(spark)).path)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def stored() -> int:
        return sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    def shuffled() -> set[str]:
        files = blocks.getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    swept(spark)
    time.sleep(2)
    left, held, before, seen = [], {}, stored(), shuffled()

    def watched(df, what="stage"):
        out = staged(df, what)
        held[what] = max(held.get(what, 0), stored() - before)
        end = time.time() + 5
        while shuffled() - seen and time.time() < end:
            time.sleep(0.05)
        left.append((what, len(shuffled() - seen)))
        seen.update(shuffled())
        if what == "classes":
            held["one"] = sum(p.stat().st_size for p in Path(urlparse(out.staged_path).path).rglob("*.parquet"))
        return out

    monkeypatch.setattr(jaccard, "staged", watched)
    monkeypatch.setattr(jaccard, "swept", lambda spark: None)
    got = {r[0]: r[2] for r in jaccard.joined(docs).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert [x for x in left if x[1]] == []
    one = held.pop("one")
    assert max(held.values()) < 3 * one, (one, held)


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {x[0]: x[1] for x in components(spark.createDataFrame(pairs, "x long, y int")).collect()}
    nodes = {n for p in pairs for n in p if n is not None}
    want = brute_components({n: {n} for n in nodes}, lambda a, b: False)
    for _ in range(300):
        for a, b in pairs:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    touched = {n for a, b in pairs if a is not None and a != b for n in (a, b)}
    assert got == {n: want[n] for n in touched}


def test_containment(spark):
    items = [" ".join(words(100 + k, 8 + 3 * k)) for k in range(12)] + ["alpha beta", "", None, "alpha beta"]
    long = words(7, 6000)
    texts = []
    for k in range(12):
        w = items[k].split()
        at = 400 * k
        texts.append(" ".join(long[:at] + [x.upper() + "," for x in w] + long[at:]))
        texts.append(" ".join(long[:at] + w[: len(w) // 2] + long[at:]))
    texts += ["see alpha, beta!", "alpha gamma beta", "", None, items[3]]
    found = contamination.contained(
        spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, items[0], 1)], "doc_id long, text string, item int"),
        spark.createDataFrame(list(enumerate(items)) + [(None, "x y z")], "item_id long, text string"),
    ).collect()

    def shingles(text, n):
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for j, item in enumerate(items):
        n = next((n for n in range(5, 0, -1) if shingles(item, n)), None)
        for i, text in enumerate(texts):
            if n and (s := len(shingles(item, n) & shingles(text, n))) * 100 >= 80 * len(shingles(item, n)):
                want[i, j] = s
    assert {(r[0], r[1]): r[2] for r in found} == want and len(found) == len(want)


def test_containment_empty(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "a b c d e f")], "doc_id long, item_id long, text string")
    assert contamination.contained(none, some).count() == contamination.contained(some, none).count() == 0


def test_packing(docs, texts, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.packed(docs, path, capacity=512).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for i, text in [*enumerate(texts), (None, texts[0])]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["length"] for r in pieces] == [len(ids[k : k + 512]) for k in range(0, len(ids), 512)]
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == 512 * r["piece"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    total = 0
    for rows in by_bin.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
        total += at
    alone = packing.best_fit(np.array([r["length"] for r in got]), 512)[2]
    assert -(-total // 512) <= len(by_bin) <= alone + 3
    assert packing.packed(docs.limit(0), path).count() == 0
    monkeypatch.setattr(packing, "BLOCK_PIECES", 10)
    blocks = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.packed(docs, path, capacity=512).collect()}
    assert blocks == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in got}


def test_packing_in_order_of_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 2000)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.range(6000, numPartitions=4).selectExpr("id doc_id", "trim(repeat('a ', if(id < 3000, 59, 39))) text")
    got = packing.packed(rows, path, capacity=100)
    filled = got.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    assert sum(r["sum(length)"] for r in filled) == 300_000 and max(r["sum(length)"] for r in filled) <= 100
    assert len(filled) <= 3030


def test_best_fit():
    sizes = np.array([5, 5, 4, 3, 3, 10, 1])
    bins, offsets, count = packing.best_fit(sizes, 10)
    assert count == 4 and max(np.bincount(bins, sizes)) <= 10 and len(set(zip(bins, offsets))) == len(sizes)


def test_shards(docs, texts):
    got = shards.sharded(docs, 4).collect()
    assert len(got) == len(texts) + 1
    sums, shard_of = [0] * 4, {}
    for r in got:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else texts[0]) or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        sums[r["shard"]] += r["size"]
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    biggest = len(texts[-1]) + 1  # alone larger than a fair share
    rest = sorted(sums)[:-1]
    assert max(sums) == biggest and max(rest) - min(rest) <= 0.02 * max(rest)
    assert shards.sharded(docs.limit(0), 4).count() == 0


def test_differencing():
    parts = shards.differenced([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    assert shards.differenced([], 3) == [[], [], []] and shards.differenced([2], 1) == [[0]]


def test_chat(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "### user: x", "a\\", "</turn>\n### assistant: hi", "ü\u20ac😀\n\n", "x" * 50_000]
    rows = []
    for conv in range(12):
        for turn in range(conv * 3):
            role = ["user", "assistant", "sys:tem", None, "### a"][(conv + turn) % 5]
            rows.append((conv, turn, role, odd[(conv * turn + turn) % len(odd)], 1))
    rows += [(90, 1, "assistant", "b", 1), (90, 1, "assistant", "b", 1), (None, 0, "user", "n", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").repartition(7)
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(frame)).collect()}
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.formatted(frame.limit(0))).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + 0.15 * r.standard_normal(16)).tolist(), 1) for i in range(900)]
    rows += [(900 + i, rows[i][1], 1) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [1.0, 2.0], 1)]
    rows += [(2005, [2.0, 4.0], 1), (2006, [], 1), (2007, [float("inf")] * 16, 1), (None, rows[0][1], 1)]
    got = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")).collect()
    assert len(got) == len(rows)
    good = {i: np.array(v) for i, v, _ in rows if i is not None and (i < 2000 or i in (2004, 2005))}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    want = brute_components({i: {i} for i in unit}, lambda a, b: next(iter(b)) in links[next(iter(a))])
    wrong = 0
    for r_ in got:
        if r_["vec_id"] in unit:
            assert r_["n_links"] <= len(links[r_["vec_id"]])
            wrong += r_["n_links"] != len(links[r_["vec_id"]]) or r_["component_id"] != want[r_["vec_id"]]
        else:
            assert (r_["n_links"], r_["component_id"]) == (0, r_["vec_id"])
    assert wrong <= 0.02 * len(unit)
    assert vectors.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_urls(spark):
    rules = [
        urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("a.example.net", "/en/x", "block"),
        urls.Rule("net", "/", "allow"), urls.Rule("é.org", "/ü", "block"),
    ]
    cases = {
        "http://x.net/a": ("x.net", "/a", "net/", "block"),
        "HTTP://A.Example.NET/en/xy?q#f": ("a.example.net", "/en/xy", "a.example.net/en/x", "block"),
        "https://b.example.net/en/": ("b.example.net", "/en/", "example.net/en/", "allow"),
        "https://example.net": ("example.net", "", None, "allow"),
        "x://notnet/": ("notnet", "/", None, "allow"),
        "x://é.org/ü/1": ("é.org", "/ü/1", "é.org/ü", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b\n.net/\nc://d": ("b\n.net", "/\nc://d", "net/", "block"),
    }
    frame = spark.createDataFrame([(u, "old", 9) for u in cases], "url string, rule string, host int")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(frame, rules).collect()}
    assert got == cases
    assert urls.judged(frame.limit(0), rules).count() == 0
    assert {r["rule"] for r in urls.judged(frame, []).collect()} == {None}


def test_urls_in_blocks(spark, monkeypatch):
    """The longest rule wins whichever pass finds it."""
    monkeypatch.setattr(urls, "BLOCK_BYTES", 1)
    rules = [urls.Rule("example.net", "/en/", "allow"), urls.Rule("net", "/", "block"), urls.Rule("a.example.net", "/en/", "block"), urls.Rule("net", "/", "allow")]
    cases = {"http://example.net/en/x": "example.net/en/", "http://b.net/x": "net/", "http://a.example.net/en/": "a.example.net/en/", "http://x.org/": None}
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in urls.judged(frame, rules).collect()}
    verdicts = {"example.net/en/": "allow", "net/": "block", "a.example.net/en/": "block", None: "allow"}
    assert got == {u: (rule, verdicts[rule]) for u, rule in cases.items()}


def test_digest_array_confirms_full_strings():
    array = urls.DigestArray([(b"a", 1), (b"b", 2)])
    array.image = array.image.replace(b"ab\0", b"xy\0").replace(b"ba\0", b"yx\0")
    assert array.probe([b"a", b"b"]).tolist() == [-1, -1]
    assert urls.DigestArray([(b"a", 1)]).probe([b"a", b"c", b""]).tolist() == [1, -1, -1]


def test_extraction(spark):
    page = (
        "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use"
        " cookies.</div><article><h1>A &amp; B</h1><p>One  <b>two</b>\n three.<p>Fünf &lt;six&gt;<br>seven.</p><script>var a='</p>';"
        "</script><div class=ad>Buy this now.</div></article><section class='comments'><article class=comment><p>I like it a lot."
        "</p></article></section><footer>&copy; 2020 x</footer></body>"
    )
    rows = [(1, page, "old"), (2, None, "old"), (3, "", "old"), (4, "<p", "old"), (5, page, "old"), (6, "<article><p>" + "long words. " * 40_000, "x")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extracted(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    want = "A & B\nOne two three.\nFünf <six> seven."
    assert got[1] == got[5] == (want, len(want))
    assert got[2] == got[3] == ("", 0)
    assert got[6][1] == 12 * 40_000 - 1


def test_raw_elements_end():
    """What stands behind self-closed, custom and unclosed elements is read."""
    cases = {
        "<p>a</p><svg viewBox='0 0 1 1'/><p>b</p><svg><title>x</title></svg><p>c": ["a", "b", "c"],
        "<p>a</p><video-player src=x></video-player><p>b</p><object-x>c</object-x><script-x>d</script-x>": ["a", "b", "c", "d"],
        "<p>a</p><video src=x><p>b</p>": ["a", "b"],
        "<p>a</p><SVG><text>x</text></SVG ><noscript>y</noscript><p>b</p><style/>p {}</style><p>c</p><script>var x": ["a", "b", "c"],
    }
    assert {page: [b.text for b in extraction.blocks_of(page)] for page in cases} == cases


def test_extraction_held_out():
    field = extraction.default_field()
    pages = [extraction._Writer(seed).page() for seed in range(5000, 5100)]
    pairs = [(a, b) for page, labels in pages for a, b in zip(field.labels(extraction.blocks_of(page)), labels, strict=True)]
    assert sum(a == b for a, b in pairs) >= 0.98 * len(pairs)


def test_secrets(spark):
    key = hashlib.sha1(b"1").hexdigest()
    rows = [
        (1, f'use token = "{key}" ok', 1), (2, None, 1), (3, "", 1), (4, f"commit {key} fixes it", 1), (5, "é" * 70_000 + f' api_key = "{key}"', 1),
        (6, "call 4952935900253052 now", 1), (7, f'token = "{key}" and token = "{key[::-1]}"', 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, findings int")
    forest = secrets.fitted(spark)
    got = {r["doc_id"]: [r["text_"][f["start"] : f["stop"]] for f in r["findings"]] for r in secrets.scanned(frame.selectExpr("doc_id", "text", "text as text_"), forest).collect()}
    assert got == {1: [key], 2: [], 3: [], 4: [], 5: [key], 6: [], 7: [key, key[::-1]]}
    clean = {r["doc_id"]: r["text"] for r in secrets.scanned(frame, forest, clean=True).collect()}
    assert clean[1] == 'use token = "[secret]" ok' and clean[2] is None and clean[4] == rows[3][1]
    assert clean[7] == 'token = "[secret]" and token = "[secret]"'


def test_secrets_unquoted(spark):
    """An unquoted assignment is one finding, and what stands behind it stays."""
    key = hashlib.sha1(b"1").hexdigest()
    cases = {
        f"token={key} more words": "token=[secret] more words",
        f"? token={key}": "? token=[secret]",
        f"export API_KEY={key}; client_secret={key[::-1]} and all that follows": "export API_KEY=[secret]; client_secret=[secret] and all that follows",
        "password: aB3!xY9z#Qw8Rt5vN2mK1pL7 more words": "password: [secret] more words",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    forest = secrets.fitted(spark)
    clean = {r["doc_id"]: r for r in secrets.scanned(frame, forest, clean=True).collect()}
    assert [clean[i]["text"] for i in range(len(cases))] == list(cases.values())
    assert [len(clean[i]["findings"]) for i in range(len(cases))] == [1, 1, 2, 1]


def test_secret_candidates_cover_the_written_secrets():
    texts, places = [], []
    for seed in range(60_001, 61_001, 2):
        value, before, after = secrets._Writer(seed).secret()
        texts.append((before + value + after).encode())
        places.append((len(before.encode()), len((before + value.rstrip("./-+")).encode())))
    extra = [
        ("see ", "AKIA" + "ABCDEFGH" * 2, " here"), ("password=", "x" * 150 + "!#" + "y" * 150, " and"), ("https://me:", "hunter!two", "@db.example.org/x"),
        ("accessToken: ", "Kugnd!WnJVq", "\n"), ("-H 'Authorization: Bearer ", "RY%RneisAA", "'"), ("a?token=", "correct!horse", "&next=1"),
    ]
    texts += ["".join(x).encode() for x in extra]
    places += [(len(b), len(b + v)) for b, v, _ in extra]
    offsets = np.cumsum([0, *map(len, texts)])
    found = secrets.candidates(np.frombuffer(b"".join(texts), np.uint8), offsets)
    held = {row: [(a - offsets[row], b - offsets[row]) for r, a, b in found if r == row] for row, *_ in found}
    assert all(any(a <= low and high <= b for a, b in held.get(row, ())) for row, (low, high) in enumerate(places))
    assert all(held[row] == [places[row]] for row in range(500, 506))


def test_secrets_held_out(spark):
    forest = secrets.fitted(spark)
    x, y = [], []
    for seed in range(50_000, 50_600):
        writer = secrets._Writer(seed)
        value, before, after = writer.secret() if seed % 2 else writer.harmless()
        x.append(secrets.features(value, before[-secrets.AROUND :], after[: secrets.AROUND]))
        y.append(seed % 2)
    assert np.mean((forest.scores(np.array(x)) >= 0.5) == np.array(y)) >= 0.95


def test_toxicity(spark):
    insults = ["grumblefix", "snotwart", "fuzzlebrain"]
    rows, labels = [], []
    for i in range(400):
        w = words(i, 60)
        toxic = i % 4 == 0
        if toxic:
            w[i % 60] = insults[i % 3].capitalize() + "!"
        rows.append((i, " ".join(w), "old", 1))
        labels.append((i, int(toxic)))
    plain = " ".join(words(9999, 40))
    extra = [f"{plain} snot-wart", f"{plain} s n o t w a r t", f"{plain} snotwwart", plain, "", None, (plain + " ") * 400 + "grumblefix"]
    rows += [(1000 + i, t, "old", 1) for i, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, n int")
    labels = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels.where("doc_id % 5 <> 0 or doc_id is null"))
    got = {r["doc_id"]: r["score"] for r in toxicity.marked(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in range(0, 400, 5)]) >= 0.95
    assert [got[1000 + i] >= 0.5 for i in range(7)] == [True, True, True, False, False, False, True]
    none = toxicity.fitted(docs, labels.limit(0))
    assert {r["score"] < 0.5 for r in toxicity.marked(docs, none).collect()} == {True}


def test_subsequence_kernel_by_enumeration():
    units = [u for w in ("idiot", "mississippi", "abc", "x0rz9", "grumblefixing") for u in toxicity.units_of(w)]
    row, key, weight = toxicity.features(units)
    for k, unit in enumerate(units):
        held: dict[int, float] = {}
        for i in range(len(unit)):
            for j in range(i + 1, len(unit)):
                for m in range(j + 1, len(unit)):
                    if m - i <= 5:
                        name = (unit[i] * 32 + unit[j]) * 32 + unit[m]
                        held[name] = held.get(name, 0) + toxicity.DECAY ** (m - i - 2)
        norm = sum(v * v for v in held.values()) ** 0.5
        got = dict(zip(key[row == k].tolist(), weight[row == k].tolist()))
        assert got.keys() == held.keys() and all(abs(got[n] - v / norm) < 1e-12 for n, v in held.items())


def test_toxicity_tolerates_insertions():
    insults, r = ["grumblefix", "snotwart", "fuzzlebrain", "dimwit"], random.Random(5)
    bags = []
    for i in range(600):
        w = words(i, 60) + ([insults[i % 4]] if i % 3 == 0 else [])
        bags.append((int(i % 3 == 0), sorted(set(w))))
    model = toxicity.trained(bags, 1 / 3)

    def toxic(text: str) -> bool:
        found = toxicity._words(text)
        return bool(model.probability(model.word_margins(found, np.array([len(found)])).max()) >= 0.5)

    kinds: dict[str, list[bool]] = {}
    for w in insults:
        for at in range(1, len(w)):
            one, two = (("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))) for n in (1, 2))
            for kind, more in (("letter", one), ("two letters", two), ("repeat", w[at]), ("space", " "), ("sign", r.choice("*-._"))):
                kinds.setdefault(kind, []).append(toxic(f"abc {w[:at]}{more}{w[at:]} fgh"))
    assert {k: np.mean(v) >= 0.9 for k, v in kinds.items()} == dict.fromkeys(kinds, True), {k: np.mean(v) for k, v in kinds.items()}
    assert np.mean([toxic(" ".join(words(10_000 + i, 60))) for i in range(300)]) <= 0.01


def test_toxicity_joins_no_words_of_different_texts():
    model = toxicity.trained([(i % 2, ["snotwart" if i % 2 else "garden", *words(i, 20)]) for i in range(60)], 0.5)
    apart = model.word_margins(["snot", "wart"], np.array([1, 1]))
    assert model.word_margins(["snot", "wart"], np.array([2]))[0] > apart.max()
    assert model.word_margins(["snot", "wart"], np.array([0, 1, 0, 1])).tolist() == apart.tolist()
    assert model.word_margins([], np.array([0])).tolist() == []


def test_forgetful_encoder(monkeypatch):
    """Ids do not depend on what a worker remembers; what it meets most often stays."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from signalsift.llm import tokens

    for name, value in (("CACHE_PIECES", 40), ("KEPT_PIECES", 10), ("CACHE_WORDS", 5)):
        monkeypatch.setattr(tokens, name, value)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), tokens.WordEncoder(path)
    odd = ["", "  ", "the The THE, the.", "don't stop-me 12345", "İstanbul été é", "日本 \U0001f600x", "<|endoftext|> a<|endoftext|>b", "z" * 3000]
    texts = [f"{odd[i % len(odd)]} the word{i} and w{i % 7}rd{i // 3},x the" for i in range(120)]
    for at in range(0, len(texts), 9):
        part = texts[at : at + 9]
        for text, ids in zip(part, encoder.encode([t.encode() for t in part])):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(encoder._number) < 120
    assert {b"the", b"and"} <= set(encoder._number)


def test_training_lets_go_of_other_operators(monkeypatch):
    """Tasks that prepare or train a model first free what the worker keeps for other operators and for earlier models."""
    from signalsift.llm import batches, toxicity

    for task in (toxicity._bagger, toxicity._trainer(0.5)):
        freed = []
        monkeypatch.setattr(batches, "_cache", {"tokens": lambda: freed.append("tokens"), "toxicity": lambda: freed.append("toxicity")})
        list(task(iter([])))
        assert freed == ["tokens", "toxicity"]


def test_training_memory():
    """The projection of the subsequences (100 MB at most) is never held in double precision as a whole."""
    import tracemalloc

    from signalsift.llm import toxicity

    random.seed(5)
    words = ["".join(random.choices("abcdefghijklmnopqrst", k=8)) for _ in range(3000)]
    bags = [(i % 2, [*words[7 * i : 7 * i + 7], "snotwart" if i % 2 else "garden"]) for i in range(400)]
    tracemalloc.start()
    toxicity.trained(bags, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 290e6, peak


def test_new_pieces_are_split_together():
    """Many new pieces take one call of the pattern, odd ones between them their own steps; the ids are the tokenizer's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from signalsift.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), tokens.WordEncoder(path)
    calls = []

    class Counted:
        def findall(self, text, pattern=encoder._split):
            calls.append(text)
            return pattern.findall(text)

    encoder._split = Counted()
    odd = ["日本", "İx", "a<|endoftext|>B", "ét́", " ", "x y", "##.%%%", "don't", "Ünö", "it's'll'd", "\u0001", "5.5,"]
    texts = [" ".join(f"w{a}{i}q {w}{i % 5} {w}" for a, w in zip("bcdefghijklm", odd)) for i in range(60)] + ["", " ", "日"]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 2
