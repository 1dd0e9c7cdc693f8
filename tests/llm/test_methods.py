"""Each operator's method against a plain version of it, its SQL, held-out labels or planted
cases; costs of very long inputs; empty tables and repeated rows."""

import itertools
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

neardup = pytest.importorskip("chunkloom.llm.neardup")
import corpus_pipeline  # noqa: E402
from chunkloom.llm import decontam, langid, licenses, packing, pii, queries, secrets, spans, tiff, toxicity, urlrules  # noqa: E402

SMALL, MID, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))
TABLES = "documents pages benchmark labels".split()


def texts_frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def spelled(v):
    return str(v) if v is None or isinstance(v, str) else f"{float(v):.6g}"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(spelled(r[k]) for k in cols) for r in df.collect())
    out = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in out.description]
    want = sorted(tuple(spelled(dict(zip(names, row))[k]) for k in cols) for row in out.fetchall())
    assert sorted(names) == cols and got == want


# --- URL rules


def labelled_urls(n, seed):
    """Bad hosts, a bad path template under any host, and a pair of tokens that is bad together only."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        host, path = rng.choice(["news", "shop", "wiki", "cdn", "spam"]), rng.choice(["a", "b", "promo", "item"])
        bad = host == "spam" or path == "promo" or (host == "cdn" and path == "b")
        rows.append((i, f"https://{rng.choice(['www', 'm'])}.{host}.example.biz/{path}/{rng.randrange(999)}?ref={i}", bad if rng.random() < 0.97 else not bad, bad))
    return rows


def test_url_rules_by_brute_force_and_held_out(spark):
    rows = labelled_urls(900, 1)
    p = urlrules.Params()
    model = urlrules.mine(spark.createDataFrame([r[1:3] for r in rows], "url string, block boolean"), p)
    parts = lambda u: re.match(r"[^:]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", u).groups("")

    def tokens(u):
        h, path, q = parts(u)
        return frozenset(["h:" + x for x in h.split(".") if x] + ["p:" + re.sub("[0-9]+", "0", x) for x in path.split("/") if x] + ["q:" + x.split("=")[0] for x in q.split("&") if x])

    counts = {}
    for _, u, block, _ in rows:
        for k in range(1, 9):
            for s in itertools.combinations(sorted(tokens(u)), k):
                n, b = counts.get(s, (0, 0))
                counts[s] = (n + 1, b + block)
    total, bad = len(rows), sum(r[2] for r in rows)
    least = math.ceil(max(p.support, p.least_urls / total) * total - 1e-9)
    rules = {frozenset(s): b / n for s, (n, b) in counts.items() if b >= least and b / n >= p.confidence and (b / n) / (bad / total) >= p.lift}
    new = labelled_urls(400, 2)
    pages = spark.createDataFrame([(r[0], r[1]) for r in new], "page_id long, url string")
    got = {r["page_id"]: r["confidence"] for r in urlrules.judge(pages, model).collect()}
    want = {i: max([c for s, c in rules.items() if s <= tokens(u)], default=0.0) for i, u, _, _ in new}
    assert got == pytest.approx(want)
    hit = [r for r in new if got[r[0]] > 0]  # held out: the marks without noise
    assert sum(r[3] for r in hit) / len(hit) > 0.99 and len(hit) / sum(r[3] for r in new) > 0.99


def test_url_rules_with_many_shared_tokens(spark):
    site = ".".join(f"l{i}" for i in range(25))  # 2^25 sets, were each token an item
    rows = [(f"http://{site}.biz/x/{i}", True) for i in range(40)] + [(f"http://ok{i}.org/y", False) for i in range(60)]
    model = urlrules.mine(spark.createDataFrame(rows, "url string, block boolean"))
    pages = spark.createDataFrame([(1, f"http://{site}.biz/q"), (2, "http://l3.biz/"), (3, "http://fine.net/"), (4, "http://x.biz/" + "y/" * 50000), (1, f"http://{site}.biz/q")], "page_id long, url string")
    got = sorted((r["page_id"], r["verdict"]) for r in urlrules.judge(pages, model).collect())
    assert got == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "block")]
    assert urlrules.judge(pages.limit(0), model).count() == 0


# --- spans, secrets, personal data


def test_many_spans_cost_in_proportion(spark):
    patterns = {"d": "[0-9]+", "w": "[ab]{2,}"}

    def run(n):
        df = spans.with_spans(texts_frame(spark, ["1 ab é𝒳 " * n]), "text", patterns).withColumn("apart", spans.apart_from(F.col("w"), F.col("d")))
        tags = F.concat(spans.tagged(F.col("d"), "d", 0), spans.tagged(F.col("w"), "w", 1))
        began = time.time()
        r = df.select(F.size("apart").alias("n"), F.element_at("d", -1).alias("last"), spans.redacted(F.col("text"), tags).alias("t")).first()
        assert r["n"] == n and tuple(r["last"]) == (8 * (n - 1), 8 * (n - 1) + 1, "1") and r["t"] == "[D] [W] é𝒳 " * n
        return time.time() - began

    run(100)
    assert run(50_000) < 60


def test_apart_from_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab12 ") for _ in range(rng.choice([0, 5, 80, 900]))) for _ in range(30)]
    df = spans.with_spans(texts_frame(spark, texts), "text", {"x": "[ab0-9]{3,6}", "y": "[0-9 ]{2,}"}).withColumn("z", spans.apart_from(F.col("x"), F.col("y")))
    for r in df.collect():
        assert [tuple(x) for x in r["z"]] == [tuple(x) for x in r["x"] if not any(x["s"] < y["e"] and y["s"] < x["e"] for y in r["y"])]


IDENTIFIERS = "configuration value number hello world function internal server request handler update status customer order address payment".split()


def test_markov_tells_keys_from_identifiers(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = secrets.train(docs)
    rng = random.Random(3)
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in secrets.KEY_ALPHABETS for n in (16, 20, 32, 40) for _ in range(20)] + ["x7k2m9q4w8e1r5t3y6u0"]
    names = ["configuration_value_number_12", "hello_world_function_number_9"]
    while len(names) < 600:
        w, n = [rng.choice(IDENTIFIERS) for _ in range(3)], str(rng.choice([1, 9, 12, 2024]))
        names.append(rng.choice(["_".join([*w, n]), "-".join([*w, n]), "".join(x.title() for x in w) + n, "_".join(w).upper(), "/".join(w)]))
    df = spark.createDataFrame([(t, 1) for t in keys] + [(t, 0) for t in names], "t string, y int")
    got = df.select("t", "y", secrets.is_random(F.col("t"), model).alias("said")).collect()
    recall = sum(r["said"] for r in got if r["y"]) / len(keys)
    precision = sum(r["said"] for r in got if r["y"]) / sum(r["said"] for r in got)
    assert recall > 0.98 and precision > 0.98 and not any(r["said"] for r in got if r["t"] in names[:2])
    texts = [f"see {keys[0]} and {keys[-1]}, also {names[0]} thanonontionionerlich", None, "", "aB3" * 200_000]
    began = time.time()
    rows = {r["doc_id"]: [x["m"] for x in r["markov"]] for r in secrets.scan(texts_frame(spark, texts), model).collect()}
    assert time.time() - began < 60 and "x7k2m9q4w8e1r5t3y6u0" in rows[0] and names[0] not in rows[0] and rows[1] == rows[2] == [] and len(rows[3]) <= 1
    twice = texts_frame(spark, texts[:1]).union(texts_frame(spark, texts[:1]))
    assert len({tuple(r) for r in secrets.digest(secrets.scan(twice, model)).collect()}) == 1 and secrets.scan(twice.limit(0), model).count() == 0


PLANTED = ["write to anna.meier (at) example.org today", "mail bob[at]mail.example.net ok", "host 192[.]168[.]10[.]7 is down", "card 4111.1111.1111.1111 expires", "call (212) 555-0199 now", "ring 212.555.0199"]
PLAIN = ["on 2024-03-17 we met", "version 3.11.4 of it", "at 10:22:31 sharp", "pages 112-118 of", "isbn 978-3-16-148410-0", "we were 12 500 people", "plain words only", None, ""]


def test_boosted_spans_find_disguises(spark):
    model = pii.train(spark.read.parquet(f"{MID}/documents.parquet"))
    assert model.expression
    got = {r["doc_id"]: [x["m"] for x in r["boosted"]] for r in pii.scan(texts_frame(spark, PLANTED + PLAIN), model).collect()}
    assert sum(bool(got[i]) for i in range(len(PLANTED))) >= len(PLANTED) - 1
    assert not any(got[len(PLANTED) + i] for i in range(len(PLAIN)))
    out = {r["doc_id"]: r["text"] for r in pii.redact(texts_frame(spark, PLANTED + PLAIN), model).collect()}
    assert "anna" not in out[0] and out[len(PLANTED)] == PLAIN[0] and out[len(PLANTED) + 7] is None
    long = texts_frame(spark, ["mail a@b.co or 10.0.0.1 and 1234567 " * 20_000])
    began = time.time()
    assert pii.redact(long, model).first()["text"].startswith("mail [EMAIL] or [IP] and ") and time.time() - began < 90
    assert pii.scan(long.limit(0), model).count() == 0


def test_lessons_have_both_classes(spark):
    rows = pii.lessons(spark.read.parquet(f"{SMALL}/documents.parquet")).groupBy("y").count().collect()
    assert {r["y"] for r in rows} == {0.0, 1.0} and min(r["count"] for r in rows) > 10


# --- decontamination


def test_parts_of_the_index_give_what_one_gives(spark):
    docs, bench = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda p: sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["question_overlap"], r["answer_overlap"]) for r in decontam.contaminated(docs, bench, p).collect())
    few = decontam.Params(least_overlap=0.05, least_score=0.2)
    one = rows(few)
    assert len(one) > 30 and one == rows(decontam.Params(least_overlap=0.05, least_score=0.2, index_bytes=900, parts_per_pass=3))


def test_a_leaked_question_counts_without_its_answer(spark):
    question = "which of the seven small rivers that cross the old town carries the largest stones in early spring"
    bench = spark.createDataFrame([(1, f"{question}? It is the northern one near the mill."), (2, "unrelated words about other things entirely. none.")], "item_id long, text string")
    docs = texts_frame(spark, [f"intro {question} outro", "It is the northern one near the mill.", "nothing here", None])
    found = [(r["doc_id"], r["item_id"], r["question_overlap"], r["answer_overlap"]) for r in decontam.contaminated(docs, bench).collect()]
    assert found == [(0, 1, 1.0, 0.0)] and decontam.keep_clean(docs, bench).count() == 3
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs.union(docs), bench).count() == 2


# --- language, toxicity


def backoff(train, text):
    """Word-first backoff, plainly: one language's sum after another."""
    names = sorted({lang for _, lang in train})
    letters = lambda t: re.findall("[a-zäöüß]+", (t or "").lower())
    words = {lang: [w for t, x in train if x == lang for w in letters(t)] for lang in names}
    tables = [({lang: {w: words[lang].count(w) for w in set(words[lang])} for lang in names}, 2)]
    for k in range(1, 6):
        grams = {lang: {} for lang in names}
        for lang in names:
            for w in words[lang]:
                s = f" {w} "
                for j in range(len(s) - k + 1):
                    grams[lang][s[j : j + k]] = grams[lang].get(s[j : j + k], 0) + 1
        tables.append((grams, 2 if k >= 3 else 1))

    def logs(table, least):
        known = {x for lang in names for x in table[lang] if sum(table[y].get(x, 0) for y in names) >= least}
        size = {lang: sum(table[lang].get(x, 0) + 0.5 for x in known) for lang in names}
        return known, lambda x, lang: math.log((table[lang].get(x, 0) + 0.5) / size[lang])

    levels = [logs(*t) for t in tables]
    total = sum(map(len, words.values()))
    score = {lang: math.log(max(1, len(words[lang])) / total) for lang in names}
    for w in letters(text):
        if w in levels[0][0]:
            for lang in names:
                score[lang] += levels[0][1](w, lang)
            continue
        s = f" {w} "
        for k in range(5, 0, -1):
            got = [s[j : j + k] for j in range(len(s) - k + 1) if s[j : j + k] in levels[k][0]]
            if got:
                for lang in names:
                    score[lang] += sum(levels[k][1](g, lang) for g in got) / len(got)
                break
    return max(names, key=lambda lang: score[lang]), score


def test_language_by_brute_force():
    train = [("the cat sat on the mat the end", "en"), ("der hund saß auf der matte das ende", "de"), ("the dog and the bird", "en"), ("ein vogel und der hund", "de")]
    model = langid.fit([t for t, _ in train], [x for _, x in train])
    s = langid.Scorer(model)
    rng = random.Random(1)
    pool = "the der cat hunde vogelin matting ungeheuer this dogs auf qqq".split()
    for _ in range(60):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))
        lang, score = backoff(train, text)
        if abs(score["en"] - score["de"]) > 1e-3:
            assert s.predict([text])[0][0] == lang, text


def test_language_of_signs_that_are_no_letters(spark):
    model = langid.fit(["the cat", "der hund"], ["en", "de"])
    got = [r["lang_pred"] for r in langid.identify(texts_frame(spark, ["½ ²", "① Ⅷ", "12 __", None, "", "²the½cat", "the", "the"]).coalesce(1), model).orderBy("doc_id").collect()]
    assert got == ["und"] * 5 + ["en"] * 3
    docs = spark.createDataFrame([(i, f"wort{i % 3} der", "de") for i in range(30)] + [(1, "wort1 der", "de")] * 50, "doc_id long, text string, lang string")
    assert langid.train(docs).languages == ["de"]


def test_toxicity_by_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    model = toxicity.fit(texts, [int("abc" in t or i % 5 == 0) for i, t in enumerate(texts)], toxicity.Params(buckets=1 << 12, steps=20))
    p, weights = model.params, model.gram_scores

    def plainly(text):
        own, best = toxicity.words_of(text), []
        for at in range(0, max(1, len(own)), p.window):
            seen, total, n = set(), 0.0, 0
            for w in own[at : at + p.window]:
                if w not in seen:
                    grams, _ = toxicity.grams_of([w], p)
                    total, n = total + weights[grams].sum(), n + len(grams)
                seen.add(w)
            best.append(total / max(p.least, n))
        return 1 / (1 + math.exp(-max(-40, min(40, max(best) + model.bias))))

    got = toxicity.Scorer(model).scores(texts)
    assert got == pytest.approx([plainly(t) for t in texts], abs=1e-9)


def test_toxicity_by_class(spark):
    """On the table whose labels hold some hundreds of toxic texts; a few dozen do not teach enough."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = [r for r in queries.op2_toxicity(spark, LARGE).collect() if r["held_out"] and r["doc_id"] in labels]
    said, true = [r for r in rows if r["predicted"]], [r for r in rows if labels[r["doc_id"]]]
    both = sum(labels[r["doc_id"]] for r in said)
    assert both / len(said) > 0.8 and both / len(true) > 0.7, (both, len(said), len(true))


# --- media, licenses, packing


def test_damaged_tiffs_become_error_rows(spark):
    rng = random.Random(7)
    whole = tiff.store_bytes(tiff.padded(b"some text " * 20_000))
    files = [whole, b"", None, b"II*\0", b"II*\0" + b"\xff" * 60]
    for _ in range(150):
        b = bytearray(whole)
        for _ in range(rng.choice([1, 4, 30])):
            b[rng.randrange(len(b) - 600, len(b))] = rng.randrange(256)
        files.append(bytes(b[: rng.randrange(len(b))] if rng.random() < 0.2 else b))
    rows = tiff.media_pages(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(files)], "doc_id long, media binary")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by) == len(files) and all(len(x) == x[0]["n_pages"] and (x[0]["page"] == 0 or x[0]["error"]) for x in by.values())
    assert b"".join(bytes(r["data"]) for r in by[0]) == tiff.padded(b"some text " * 20_000) and sum(x[0]["error"] is not None for x in by.values()) > 20
    tags = {256: (4, [2**31]), 257: (4, [2**31]), 258: (3, [8]), 259: (3, [8]), 273: (4, [8]), 278: (4, [0]), 279: (4, [4])}
    import struct

    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v[0]) for t, (k, v) in sorted(tags.items())) + b"\0" * 4
    with pytest.raises(tiff.FAULTS):
        list(tiff.read_pages(b"II*\0" + struct.pack("<I", 12) + b"\0" * 4 + body))


def test_media_take_all_codings(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    used = {r["compression"] for r in tiff.media_pages(tiff.texts_as_media(docs)).select("compression").distinct().collect()}
    assert used == {tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tiff.media_digest(docs).collect():
        raw = np.frombuffer(tiff.padded((texts[r["doc_id"]] or "").encode()), np.uint8)
        want = f"pages={-(-len(raw) // (576 * 256))};n={len(raw)};mean={sum(raw.tolist()) / len(raw):.4f};hist=" + ",".join(str(sum(1 for x in raw.tolist() if x // 16 == k)) for k in range(16))
        assert r["feature"] == want
    assert tiff.media_digest(docs.limit(0)).count() == 0


def test_licenses_by_brute_force(spark):
    """Whole notices among other words: each is found where it stands, and nothing else is."""
    rng = random.Random(2)
    texts, want = [], []
    for i in range(120):
        words, own = [], []
        for _ in range(rng.randint(0, 3)):
            words += [f"q{rng.randrange(9999)}" for _ in range(rng.randint(0, 40))]
            name, body = licenses.TEMPLATES[rng.randrange(len(licenses.TEMPLATES))]
            notice = licenses.WORD.findall(body)
            own.append((i, name, len(words), len(words) + len(notice)))
            words += notice
        words += [f"q{rng.randrange(9999)}" for _ in range(20)]
        texts.append(" ".join(words))
        want += own
    got = [(r["doc_id"], r["license"], r["start"], r["end"]) for r in licenses.scan(texts_frame(spark, texts)).collect()]
    by = lambda rows: sorted((i, s, e) for i, _, s, e in rows)
    missed = set(by(want)) - set(by(got))
    assert len(missed) <= 0.02 * len(want) and len(set(got) - set(want)) <= 0.02 * len(want)
    assert licenses.scan(texts_frame(spark, ["x"]).limit(0)).count() == 0


def test_packing_with_another_tokenizer(spark):
    from tokenizers import Tokenizer

    other = os.path.join(os.path.dirname(packing.tokenizer_path(packing.Params())), "byte_bpe_50k.json")
    tok = Tokenizer.from_file(other)
    tok.encode_special_tokens = True
    texts = ["Some Words  here\nand THERE.", "été; don't", "", None]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {}
    for r in packing.pack_documents(docs, packing.Params(tokenizer=other)).orderBy("doc_id", "start").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    for i, t in enumerate(texts):
        assert got[i] == np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


# --- near duplicates, pipeline


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_recall_of_planted_pairs(spark):
    """Pairs of every similarity from 0.85 on, far from all others: measured recall."""
    rng = random.Random(9)
    docs, pairs = [], []
    for k in range(500):
        words = [f"d{k}w{i}" for i in range(rng.randint(60, 200))]
        other = list(words)
        for _ in range(rng.choice([1, 1, 2, 3])):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1]):
            pairs.append(2 * k)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(pairs) > 200 and sum(got[i + 1] == i for i in pairs) / len(pairs) >= 0.995
    assert all(got[i] == i and got[i + 1] in (i, i + 1) for i in range(0, 1000, 2)) and sum(got[i + 1] == i for i in range(0, 1000, 2)) == sum(got[i + 1] == i for i in pairs)


def test_signatures_estimate_by_bit_counts():
    p, rng = neardup.Params(), np.random.default_rng(3)
    sk = neardup.Sketcher(p)
    for s in (0.0, 0.3, 0.7, 0.9, 1.0):
        errors = []
        for _ in range(30):
            both = rng.integers(0, 2**63, int(400 * s)).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, (400 - int(400 * s)) // 2).astype(np.uint64)])) for _ in "ab")
            x, y = sk.signature(a)[0], sk.signature(b)[0]
            equal = sum((u & 15) == (v & 15) for u, v in zip(x, y)) + sum(u >> 4 == v >> 4 for u, v in zip(x, y))
            est = float(neardup.estimate(neardup.as_words([x]), neardup.as_words([y]), p)[0])
            assert est == pytest.approx((equal / p.hashes - neardup.CHANCE) / (1 - neardup.CHANCE))
            errors.append(est - s)
        assert len(x) == p.hashes * neardup.BITS // 8 and abs(np.mean(errors)) < 0.03


def test_crowded_classes_are_dealt_out(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):
        d = list(base)
        d[rng.randrange(120)] = f"v{i}"
        docs.append((i, " ".join(d)))
    docs += [(None, docs[3][1]), (None, "only here and nowhere else at all"), (None, "only here and nowhere else at all"), (200, "word " * 100_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda p: sorted(map(str, neardup.near_duplicates(frame, p).collect()))
    assert rows(neardup.Params()) == rows(neardup.Params(portion=5, block=8, hubs=1))


def test_pipeline_by_brute_force(spark):
    """run() against a plain version of its stages."""
    from test_neardup import brute

    docs, labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    left = {i: t for i, t in texts.items() if scorer.scores([t])[0] < 0.5}
    left = {i: left[i] for i, (_, c) in brute(list(left.items())).items() if i == c}
    items = [set(zip(*[decontam.words_of(r["text"])[k:] for k in range(5)])) for r in bench.collect()]

    def leaks(t):
        own = set(zip(*[decontam.words_of(t)[k:] for k in range(5)]))
        return any(x and len(x & own) >= 0.8 * len(x) for x in items)

    left = {i: t for i, t in left.items() if not leaks(t)}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {p["doc_id"] for p in pieces} == set(left)
    sizes, ends = {}, {}
    for p in pieces:
        sizes[p["doc_id"]] = sizes.get(p["doc_id"], 0) + p["length"]
        ends[p["sequence_id"]] = ends.get(p["sequence_id"], 0) + p["length"]
        assert sizes[p["doc_id"]] <= p["doc_tokens"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in ends.values())
    tokens = packing.Tokens(packing.tokenizer_path(packing.Params()), 100_000)
    base = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|[0-9]{9,}|\+[0-9][ ().0-9-]+[0-9]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
    plain = [i for i, t in left.items() if not base.search(t or "")]
    same = sum(sizes[i] == len(tokens.ids(left[i])) // 4 + 1 for i in plain)
    assert len(plain) > 50 and same >= 0.97 * len(plain)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, extra columns; then empty tables."""
    long = " ".join(f"w{i}" for i in range(60_000))
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, slot int"
    rows = [(None, None, None, None, None, "k", "s", 1), (1, "", "en", "a", 0, "k", "s", 1), (2, "one two three", "en", "a", 13, "k", "s", 1), (2, "one two three", "en", "a", 13, "k", "s", 1), (3, long, "en", None, len(long), "k", "s", 1), (4, None, None, "b", None, "k", "s", 1)]
    for name, some in (("few", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(some, kind).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        if some:
            assert sorted({p["doc_id"] for p in out if p["doc_id"] is not None}) == [1, 2, 3, 4] and sum(p["length"] for p in out if p["doc_id"] == 2) < 8
        else:
            assert out == []


def test_held_out_is_the_checksum(spark):
    for r in queries.op5_language(spark, SMALL).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
