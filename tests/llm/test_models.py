"""Toxicity, language ID, TIFF, packing, decontamination, licenses and URL rules: exact round
trips, brute force, held-out accuracy, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

toxicity = pytest.importorskip("chunkloom.llm.toxicity")
from chunkloom.llm import decontam, langid, licenses, packing, tiff, urlrules  # noqa: E402
from chunkloom.llm.queries import queries  # noqa: E402

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
EDGES = [(None, None), ("", "a"), ("  \n", "a"), ("x", None), ("x", "a"), ("x", "a"), ("wort " * 30000, "b"), ("123 __ 4", "b"), ("y" * 100000, "c")]


def edge_docs(spark):
    rows = [(i, t, "en", s, 0.5, "q", 7) for i, (t, s) in enumerate(EDGES)] + [(None, "no id", None, "a", 0.1, "q", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, lang_pred string, page int")


def tables(spark, d, *names):
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def test_toxicity_held_out(spark):
    docs, labels = tables(spark, MID, "documents", "labels")
    got = {r["doc_id"]: r for r in queries()["op2_toxicity"](spark, MID).collect()}
    want = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in want if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got) and len(got) == docs.count()
    assert sum(got[i]["predicted"] == want[i] for i in held) / len(held) > 0.93


def test_toxicity_windows_and_subwords():
    rng = random.Random(3)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 200))]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), "zonkwort" + rng.choice("xyzuv"))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels, toxicity.Params(buckets=1 << 14, steps=60))
    s = toxicity.Scorer(model)
    filler = " ".join(rng.choice(clean) for _ in range(5000))
    got = s.scores([filler + " zonkwortq " + filler, filler, "", None, "   "])
    assert got[0] > 0.5 > max(got[1:]) and all(0 <= x <= 1 for x in got)
    assert toxicity.fit([], []).bias < 0


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (4, None), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 10
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_language_held_out(spark):
    got = queries()["op5_language"](spark, MID).collect()
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) / len(held) > 0.95


def test_language_edges(spark):
    docs = edge_docs(spark)
    model = langid.fit(["the cat the dog", "der hund der"], ["en", "de"])
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 7)] == ["und"] * 4
    assert langid.Scorer(model).predict(["the", "hun"]) [0][0] == "en"
    assert langid.Scorer(model).predict(["hundx"])[0][0] == "de"  # by its n-grams
    assert langid.train(docs.limit(0)).languages == [] and langid.Scorer(langid.fit([], [])).predict(["abc"]) == [("und", 0.0)]


@pytest.mark.parametrize("comp", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(comp):
    rng = random.Random(comp)
    for n in (1, 576, 577, 200_000):
        data = tiff.padded(bytes(rng.choice(b"aaab") if rng.random() < 0.6 else rng.randrange(255) for _ in range(n)))
        media = tiff.store_bytes(data, tiff.Layout(codecs=(comp,)))
        pages = list(tiff.read_pages(media))
        assert b"".join(p.data for p in pages) == data and len(pages) == -(-len(data) // (576 * 256))


def test_tiff_query_and_faults(spark):
    docs = edge_docs(spark)
    rows = {r["doc_id"]: r for r in tiff.media_digest(docs).collect()}
    for i, (t, _) in enumerate(EDGES):
        raw = (t or "").encode()
        pad = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        import hashlib

        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
    assert rows[4]["media_sha256"] == rows[5]["media_sha256"] == rows[3]["media_sha256"]
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(b"II*\0\x08\0\0\0\xff\xff"))], "doc_id long, media binary")
    assert [r["page"] for r in tiff.media_pages(bad).collect()] == [-1, -1, -1]


def test_packing_is_whole_and_full(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path(packing.Params()))
    tok.encode_special_tokens = True
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    pieces = packing.pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    docs, seqs = {}, {}
    for p in pieces:
        docs.setdefault(p["doc_id"], []).append(p)
        seqs.setdefault(p["sequence_id"], []).append(p)
    for i, r in texts.items():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        own = sorted(docs[i], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in own) == np.array(ids, "<u4").tobytes() and own[0]["doc_tokens"] == len(ids)
    for own in seqs.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0
    full = [s for s in seqs.values() if sum(p["length"] for p in s) == 2048]
    want = {}
    for p in pieces:
        want[p["source"]] = want.get(p["source"], 0) + p["length"]
    total = sum(want.values())
    mid = full[: len(full) // 2]
    for source, n in want.items():  # early windows keep the corpus' own mixture
        got = sum(p["length"] for s in mid for p in s if p["source"] == source) / (2048 * len(mid))
        assert abs(got - n / total) < 0.02


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(packing.Params())
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    ours = packing.Tokens(path, 1000)
    for t in ["Ünïcode ÀÉ ß straße. don't it's, x\x1cy\x1d z", "a b c　d\x85e", "<|endoftext|> x<|startoftext|>", "é ́a İstanbul ΣΑΣ ①²", "१२३ 漢字かな 🙂🙂", "…", "A.B.,C"]:
        assert ours.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing_edges(spark):
    pieces = packing.with_crc(packing.pack_documents(edge_docs(spark))).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 0) == 1 and len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
    assert packing.pack_documents(edge_docs(spark).limit(0)).count() == 0
    p = packing.Packer(np.array([0.75, 0.25]), np.zeros(2), 0, packing.Params())
    for i in range(40):
        p.add(i % 2, (i, b"\0" * 4 * 500, "s"))
    first = p.fill(2048)
    assert sum(x[2] for x in first if x[0][0] % 2 == 0) == 1536  # three quarters of the window


def test_packing_queue_of_every_source(spark):
    rows = [(i, "wort " * (400 - i), f"s{i:03}") for i in range(100)]  # the last source is the smallest
    p = packing.Params(length=64, targets=(("s000", 0.5), ("s099", 0.5)))
    first = {}
    for x in packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), p).collect():
        if x["sequence_id"] & ((1 << 40) - 1) == 0:
            first[x["source"]] = first.get(x["source"], 0) + x["length"]
    assert first == {"s000": 32, "s099": 32}


def test_packing_mixes_what_is_stored_by_source(spark):
    rows = [(i, "wort " * (30 + i % 7), "ab"[i >= 300] if i < 400 else f"s{i}") for i in range(410)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(8, "doc_id")
    p = packing.Params(length=256, slot_tokens=4096)
    pieces = packing.pack_documents(docs, p).collect()
    assert len(pieces) == len(packing.pack_documents(docs, p).intersect(spark.createDataFrame(pieces)).collect())
    total, windows, slots = {}, {}, {}
    for x in pieces:
        w = windows.setdefault(x["sequence_id"], {})
        for d in (w, total, slots.setdefault(x["sequence_id"] >> 40, {})):
            d[x["source"]] = d.get(x["source"], 0) + x["length"]
    every = sum(total.values())
    assert {r["doc_id"] for r in pieces} == set(range(410)) and len(slots) == -(-every // 4096)
    for own in slots.values():  # each slot has its part of each source, less or more a document
        assert all(abs(own.get(q, 0) - total[q] / len(slots)) <= 2 * 37 for q in "ab")
    done, n = 0, 0
    for _, w in sorted(windows.items()):  # the mixture holds from the first window to the last, across slots
        done, n = done + w.get("a", 0), n + sum(w.values())
        assert abs(done - n * total["a"] / every) < 128


def test_decontamination_finds_planted(spark):
    docs, bench = tables(spark, MID, "documents", "benchmark")
    hits = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}

    def shingles(t):
        w = decontam.words_of(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = {r["item_id"]: shingles(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        s = shingles(r["text"])
        want |= {(r["doc_id"], i) for i, x in items.items() if len(x & s) >= 0.8 * len(x)}
    assert hits == want and want


def test_wand_is_exhaustive():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    for _ in range(30):
        items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25)))) for i in range(60)]
        index = decontam.Index(items, decontam.Params(block=4, least_score=rng.choice([0.3, 0.6])))
        terms = sorted(rng.sample(range(len(index.lists)), 20))
        scores = {}
        for t in terms:
            for j, w in index.lists[t]:
                scores[j] = scores.get(j, 0) + w
        want = {j for j, s in scores.items() if s >= index.p.least_score - 1e-9}
        assert {j for j, _ in index.retrieve(terms)} == want


def test_decontamination_edges(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, "Wort wort wort wort wort. wort wort"), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == {(6, 1)}
    assert decontam.keep_clean(docs, bench).count() == 9
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    blocks = decontam.Params(index_bytes=20)
    assert decontam.contaminated(docs, bench, blocks).count() == 1


def test_license_alignment():
    a, b = "x a b c q d e y".split(), "a b c d e".split()
    assert licenses.align(a, b) == [(1, 0), (2, 1), (3, 2), (5, 3), (6, 4)]
    s = licenses.Scanner()
    assert [(n, c) for n, c, _, _ in s.scan("foo Licensed under CC BY-NC 4.0. bar")] == [("CC-BY-NC-4.0", 1.0)]
    assert [n for n, *_ in s.scan("foo licensed under CC BY 4.0. Released under the MIT License")] == ["CC-BY-4.0", "MIT"]
    body = licenses.TEMPLATES[3][1]
    cut = body.replace("free of charge, ", "").replace("without restriction", "with no restriction")
    found = s.scan("word " * 5000 + cut + " word" * 5000)
    assert [n for n, *_ in found] == ["MIT"] and 0.9 < found[0][1] < 1 and found[0][2] == 5000
    assert s.scan(None) == s.scan("") == s.scan("the mit of a license plate") == []


def test_license_notices_repeated():
    s = licenses.Scanner()
    got = s.scan("foo bar Licensed under CC BY 4.0. Licensed under CC BY 4.0. baz qux")
    assert got == [("CC-BY-4.0", 1.0, 2, 8), ("CC-BY-4.0", 1.0, 8, 14)]
    rng = random.Random(5)
    for name, text in licenses.TEMPLATES:
        words = licenses.WORD.findall(text)
        for gap in ("", "and", "foo bar baz"):
            one = f"{text} {gap} "
            step = len(licenses.WORD.findall(one))
            got = s.scan("head words " + one * 50 + "tail")
            assert got == [(name, 1.0, 2 + step * k, 2 + step * k + len(words)) for k in range(50)], (name, gap)
        copies = []
        for _ in range(20):  # copies that each lack one of ten words
            lost = set(rng.sample(range(1, len(words) - 1), len(words) // 10))
            copies.append(" ".join("xx" if j in lost else w for j, w in enumerate(words)))
        got = s.scan("foo bar " + " ".join(copies) + " baz")
        assert [x[0] for x in got] == [name] * 20 and [x[2] for x in got] == [2 + len(words) * k for k in range(20)]


def test_licenses_on_documents(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    got = {r["doc_id"] for r in licenses.scan(docs).collect()}
    want = {r["doc_id"] for r in docs.filter(F.lower("text").rlike("licensed under|mit license")).collect()}
    assert got == want and licenses.scan(edge_docs(spark)).count() == 0


def test_url_rules(spark):
    urls = [
        "https://a.example.org/es/x", "https://example.org/en/12", "http://A.B.COM/fr/?q=1", "http://b.com/de/z#y", "http://x.org", "nourl", None, "http://org/", "ftp://y.example.org/en/2", "http://myexample.org/en/1", "http://u@h.com:80/fr/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, urlrules.Model({})).orderBy("page_id").collect()]
    assert got == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("a.b.com", "/fr/", "com/fr/", "allow"), ("b.com", "/de/z", "com/de/", "block"),
        ("x.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/", "org/", "allow"), ("y.example.org", "/en/2", "org/", "allow"), ("myexample.org", "/en/1", "org/", "allow"), ("u@h.com:80", "/fr/", None, "allow"),
    ]


def test_url_mining(spark):
    rows = [(f"http://spam{i}.net/pills/buy?id={i}", True) for i in range(40)] + [(f"http://site{i}.net/pills/info", False) for i in range(40)] + [(f"http://n{i}.net/buy", False) for i in range(40)] + [("http://q.net/z", None)]
    model = urlrules.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert model.index
    probe = spark.createDataFrame([(1, "http://other.net/pills/buy?id=3"), (2, "http://other.net/pills/info"), (3, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlrules.judge(probe, model).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert urlrules.mine(spark.createDataFrame([], "url string, block boolean")).index == {}


def test_url_mining_keeps_every_rule(spark):
    long = "a.b.c.d.e.evil.net/p/q/r/s"  # ten tokens: 1023 rules of confidence 1
    rows = [(f"http://{long}/{i}", True) for i in range(40)] + [(f"http://weak.biz/{chr(97 + i)}", i < 16) for i in range(20)] + [(f"http://fine{i}.de/", False) for i in range(80)]
    model = urlrules.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert sum(map(len, model.index.values())) < 20  # only the shortest rules stay
    probe = spark.createDataFrame([(1, "http://weak.biz/zz"), (2, f"http://{long}/7"), (2, f"http://{long}/7"), (3, "http://fine1.de/"), (4, None)], "page_id long, url string")
    got = sorted((r["page_id"], r["verdict"], r["confidence"]) for r in urlrules.judge(probe, model).collect())
    assert got == [(1, "block", 0.8), (2, "block", 1.0), (2, "block", 1.0), (3, "allow", 0.0), (4, "allow", 0.0)]
    assert got == sorted((r["page_id"], r["verdict"], r["confidence"]) for r in urlrules.judge(probe, model, literal=0).collect())


def test_url_rules_minimal():
    rules = [(["a"], 0.7), (["a", "b"], 0.9), (["a", "c"], 0.7), (["a", "b", "d"], 0.8), (["c", "d"], 0.6)]
    kept = urlrules.minimal(rules, {"a": 3, "b": 2, "c": 2, "d": 1})
    assert sorted((x["tokens"], x["confidence"]) for own in kept.values() for x in own) == [(["a"], 0.7), (["a", "b"], 0.9), (["c", "d"], 0.6)]
