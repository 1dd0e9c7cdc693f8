"""Near-duplicates against brute force, components, and the pipeline's stages."""

import collections
import random
import re

import pytest

neardup = pytest.importorskip("chunkloom.llm.neardup")
import corpus_pipeline  # noqa: E402


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for z in s:
            where[z].append(i)
    common = collections.Counter((a, b) for own in where.values() for k, b in enumerate(own) for a in own[:k])
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def planted():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    docs, base = [], [rng.choice(words) for _ in range(200)]
    for i in range(150):  # a chain-like group of near copies of many degrees
        d = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 12])):
            d[rng.randrange(len(d))] = rng.choice(words)
        docs.append(" ".join(d))
    docs += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    docs += [None, "", " \t", "a b c", "A  b\nc", "a b", " ", docs[0].upper()]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


def test_matches_brute_force_on_planted(spark):
    docs = planted()
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, kept string, sig int")
    want = brute(docs)
    for p in (neardup.Params(), neardup.Params(block=16)):
        rows = neardup.near_duplicates(frame, p).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_components_of_long_chains(spark):
    edges = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(0, 60)] + [(b"900", b"901")]
    out = {bytes(r["id"]): bytes(r["label"]) for r in neardup.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()}
    assert {out[f"{i:03d}".encode()] for i in range(61)} == {b"000"} and out[b"901"] == b"900"


def test_edges(spark):
    frame = spark.createDataFrame([(None, "x"), (5, "one two"), (5, "one two"), (3, "one two")], "doc_id long, text string")
    rows = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame).collect()}
    assert rows == {(None, None, True), (5, 3, False), (3, 3, True)}
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = corpus_pipeline.materialize(stage(spark, docs, d), name)
        assert out.columns == docs.columns
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before and len(after) > 0.6 * len(before)
        if name == "near_duplicates":
            texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert after == {i for i, (_, c) in brute(texts).items() if i == c}
        if name == "personal_data":
            assert after == before
            assert not [r for r in out.collect() if re.search(r"[A-Za-z0-9]@mail", r["text"])]
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_stage_by_row(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a), (5, a), (7, b), (7, b), (7, c), (None, c + " more"), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(5, a), (7, b), (7, c), (9, None), (9, None), (None, "")]))
