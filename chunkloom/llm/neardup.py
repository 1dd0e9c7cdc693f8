"""Near-duplicate documents by b-bit MinHash.

A document's set is that of its five-word shingles, each a 64-bit hash. Runs of `rows` of
its `hashes` minima are hashed to band keys; of each minimum the low four bits are kept,
sixteen of them packed to a 64-bit word. The similarity of two signatures is estimated from
the bits that their exclusive or leaves, corrected for entries that are equal by chance, and
pairs that may reach the threshold are confirmed on full sets.

Copies never multiply. Equal sets are one class. A class is first held against the smallest
classes of its buckets only, those few that it meets in most bands; confirmed links join
classes into components. Buckets in which two components are left are then searched in blocks of
bounded size: first for each class's nearest one in another component, then, after those
links are joined, for every pair that is still apart. Blocks give out only pairs whose
estimate passes, each in the first band that holds both. A hub or text with many partners
is joined to them in portions (`beside`), so no task holds all pairs of one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batcher, discard, give_back, materialize, text_batches

U64 = np.uint64
BITS = 4  # kept of each minimum
CHANCE = 2.0**-BITS
LOWEST = U64(0x1111111111111111)  # the lowest bit of each entry of a word


@dataclass(frozen=True)
class Params:
    """A pair of similarity s is missed with probability (1 - s**rows) ** bands at most, 4e-5 at
    0.85 exactly and 1e-8 at 0.9, or if its estimate is `deviations` too low (3e-5 at 0.85).
    bands * rows is a multiple of 16."""

    per_cent: int = 85  # linked if 100 * intersection >= per_cent * union
    shingle: int = 5
    bands: int = 32
    rows: int = 8
    deviations: float = 4.0  # how far below the threshold an estimate may be
    hubs: int = 4  # of its buckets that a class is held against, those that it meets most often
    block: int = 512  # classes of a bucket that are held against each other at once
    portion: int = 4096  # pairs of one class that are joined to it at once
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        t = self.per_cent / 100
        equal = t + (1 - t) * CHANCE
        return t - self.deviations * (equal * (1 - equal) / self.hashes) ** 0.5 / (1 - CHANCE)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Sketcher:
    def __init__(self, p: Params):
        self.p, self.words = p, Words()
        rng = np.random.default_rng(p.seed)
        self.salt = _mix(np.arange(1, p.bands + 1, dtype=U64))  # tells bands apart
        self.mul = (rng.integers(0, 2**31, p.hashes) * 2 + 1).astype(np.uint32)
        self.in_band = (rng.integers(0, 2**63, p.rows, dtype=np.int64).astype(U64) << U64(1)) | U64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles. bytes.lower and bytes.split
        touch A-Z and the bytes 9 to 13 and 32 only."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, U64)
        if len(self.words) > 300_000:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), U64, len(words))
        k = min(self.p.shingle, len(h))
        s = np.full(len(h) - k + 1, k, U64)
        for i in range(k):
            s = s * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(s))

    def signature(self, s: np.ndarray) -> tuple[bytes, np.ndarray]:
        """From the minima of odd multiples, modulo 2^32, of the shingles' high halves: their low
        bits, packed, and the band keys."""
        x = (s >> U64(32)).astype(np.uint32)
        out = None
        for at in range(0, len(x), 1024):
            m = (x[None, at : at + 1024] * self.mul[:, None]).min(1)
            out = m if out is None else np.minimum(out, m)
        low = (out & np.uint32(15)).astype(np.uint8)
        keys = _mix((out.reshape(self.p.bands, -1).astype(U64) * self.in_band).sum(1, dtype=U64) + self.salt)
        return (low[::2] | (low[1::2] << 4)).tobytes(), keys.view(np.int64)


def set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def as_words(packed: list[bytes]) -> np.ndarray:
    """A row of 64-bit words for each signature."""
    return np.frombuffer(b"".join(packed), U64).reshape(len(packed), -1)


def estimate(x: np.ndarray, y: np.ndarray, p: Params) -> np.ndarray:
    """Similarities of rows of words: an entry differs if any of its bits does, and entries of
    different shingles are equal by chance once in sixteen times."""
    z = x ^ y
    z |= z >> U64(1)
    z |= z >> U64(2)
    equal = p.hashes - np.bitwise_count(z & LOWEST).sum(-1, dtype=np.int64)
    return (equal / p.hashes - CHANCE) / (1 - CHANCE)


def sketch(docs: DataFrame, p: Params) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("packed", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk, out = Sketcher(p), Batcher(schema)
        for b in text_batches(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = sk.shingles(text)
                if len(s):
                    row = (doc_id, len(s), set_id(s), *sk.signature(s))
                else:
                    row = (doc_id, 0, None, None, None)
                if out.add(row, 600):
                    yield out.flush()
        yield out.flush()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig binary, packed binary, keys array<long>")


def beside(pairs: DataFrame, side: DataFrame, key: str, other: str, p: Params, counted: DataFrame | None = None) -> DataFrame:
    """pairs joined with `side` (a row a key) on `key`. The pairs of a key that has more than
    p.portion of them (counted in `counted`, if that is cheaper to read) are dealt out by `other`,
    and the key's row goes with each portion."""
    crowded = (pairs if counted is None else counted).groupBy(key).agg(F.count("*").alias("_m")).filter(F.col("_m") > p.portion)
    crowded = materialize(crowded.select(key, F.ceil(F.col("_m") / p.portion).cast("int").alias("_portions")), "crowded")
    if crowded.isEmpty():
        return pairs.join(side, key)
    portions = F.coalesce("_portions", F.lit(1))
    dealt = pairs.join(crowded, key, "left").withColumn("_portion", F.pmod(F.xxhash64(other), portions).cast("int")).drop("_portions")
    again = side.join(crowded, key, "left").withColumn("_portion", F.explode(F.sequence(F.lit(0), portions - 1))).drop("_portions")
    return dealt.join(again, [key, "_portion"]).drop("_portion")


def _near_hub(pairs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose estimate may reach it."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("est", pa.float64())])
    least = p.least_estimate

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            est = estimate(as_words(batch.column(2).to_pylist()), as_words(batch.column(3).to_pylist()), p)
            ok = pa.array(est >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(est[est >= least])], schema=schema)

    c = classes.select("sig", "packed", "n")
    hubs = beside(pairs, c.select(F.col("sig").alias("a"), F.col("packed").alias("pa"), F.col("n").alias("na")), "a", "b", p)
    both = (
        hubs.join(c.select(F.col("sig").alias("b"), F.col("packed").alias("pb"), F.col("n").alias("nb")), "b")
        .filter(100 * F.least("na", "nb") >= p.per_cent * F.greatest("na", "nb"))
        .select("a", "b", "pa", "pb")
    )
    return both.mapInArrow(run, "a binary, b binary, est double")


def _pairs_in(sig: list, label: list, n: np.ndarray, words: np.ndarray, keys: np.ndarray, side: np.ndarray, band: int, nearest: bool, p: Params) -> Iterator[tuple]:
    """Pairs of one block (side 0 everywhere) or of two blocks (sides 0 and 1) in different
    components; with `nearest`, for each class the one with the highest estimate only."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(label))}
    lab = np.array([ids[x] for x in label])
    two = bool(side.any())
    least = p.least_estimate
    for at in range(0, len(sig), 32):
        rows = np.arange(at, min(at + 32, len(sig)))
        ok = lab[rows, None] != lab[None, :]
        ok &= 100 * np.minimum(n[rows, None], n[None, :]) >= p.per_cent * np.maximum(n[rows, None], n[None, :])
        if two:
            ok &= (side[rows, None] != side[None, :]) if nearest else (side[rows, None] < side[None, :])
        elif not nearest:
            ok &= rows[:, None] < np.arange(len(sig))[None, :]
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        est = np.concatenate([estimate(words[rows[i[k : k + 65536]]], words[j[k : k + 65536]], p) for k in range(0, len(i), 65536)])
        good = est >= least
        i, j, est = rows[i[good]], j[good], est[good]
        if nearest:
            order = np.lexsort((-est, i))
            first = order[np.unique(i[order], return_index=True)[1]] if len(i) else order
            i, j, est = i[first], j[first], est[first]
        else:  # a pair is given out in the first band that holds both
            new = np.argmax(keys[i] == keys[j], axis=1) == band if len(i) else np.zeros(0, bool)
            i, j, est = i[new], j[new], est[new]
        for x, y, e in zip(i.tolist(), j.tolist(), est.tolist()):
            yield (sig[x], sig[y], e)


def _apart(shared: DataFrame, labels: DataFrame, classes: DataFrame, p: Params, nearest: bool) -> DataFrame:
    """Pairs of one bucket and different components whose estimate may reach the threshold. A bucket
    of more than p.block classes is dealt out as pairs of blocks.

    With `nearest` rows are (a, b, est). Without, a block gives a row (blk, 0, a, null) for each
    class that is in a pair, and a row (blk, 1, a, bs) for a class and all its partners in the block.
    """
    placed = shared.join(labels, shared["sig"] == labels["id"], "left").select("key", "band", "sig", F.coalesce("label", "sig").alias("label"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).filter("lo != hi")
    mixed = materialize(mixed.select("key", F.ceil(F.col("m") / p.block).cast("int").alias("blocks")), "mixed")
    c = classes.select("sig", "packed", "n", "keys")
    # A crowded bucket's rows are dealt out before each becomes one for every block of the bucket.
    rows = placed.join(mixed, "key").repartition("key", "sig").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "key", "band", "sig", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    ).join(c, "sig")
    pairs_schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("est", pa.float64())])
    lists_schema = pa.schema([("blk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("bs", pa.list_(pa.binary()))])

    def run(batches):
        out, held, now = Batcher(pairs_schema if nearest else lists_schema), [], None

        def search():
            _, _, sig, label, _, _, side, packed, n, keys = zip(*held)
            pairs = _pairs_in(list(sig), list(label), np.array(n), as_words(list(packed)), np.array(keys, np.int64), np.array(side), held[0][1], nearest, p)
            if nearest:
                yield from pairs
                return
            partners: dict[bytes, list[bytes]] = {}
            for a, b, _ in pairs:
                partners.setdefault(a, []).append(b)
            block = xxhash.xxh3_64_intdigest(struct.pack("<qii", *now)) - 2**63
            for a in partners.keys() | {b for bs in partners.values() for b in bs}:
                yield (block, 0, a, None)
            for a, bs in partners.items():
                yield (block, 1, a, bs)

        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns)):
                if (row[0], row[4], row[5]) != now:
                    if len(held) > 1:
                        for pair in search():
                            if out.add(pair):
                                yield out.flush()
                    held, now = [], (row[0], row[4], row[5])
                held.append(row)
        if len(held) > 1:
            for pair in search():
                if out.add(pair):
                    yield out.flush()
        yield out.flush()

    dealt = rows.select("key", "band", "sig", "label", "i", "j", "side", "packed", "n", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sig")
    found = materialize(dealt.mapInArrow(run, "a binary, b binary, est double" if nearest else "blk long, kind int, a binary, bs array<binary>"), "apart")
    discard(placed)
    discard(mixed)
    return found


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """sig and text (that of the smallest doc_id) of the wanted classes."""
    needed = wanted.select("sig").distinct().join(classes.select("sig", "rep"), "sig")
    named = docs.filter(F.col("doc_id").isNotNull()).join(needed.filter(F.col("rep").isNotNull()), docs["doc_id"] == needed["rep"]).select("sig", "text")
    # Texts whose ids are all null are found by their sets.
    schema = pa.schema([("sig", pa.binary()), ("text", pa.string())])

    def run(batches):
        sk, out = Sketcher(p), Batcher(schema)
        for b in text_batches(batches):
            for text in b.column(0).to_pylist():
                s = sk.shingles(text)
                if len(s) and out.add((set_id(s), text), len(text)):
                    yield out.flush()
        yield out.flush()

    unnamed = docs.filter(F.col("doc_id").isNull()).select("text").mapInArrow(run, "sig binary, text string")
    unnamed = unnamed.join(needed.filter(F.col("rep").isNull()).select("sig"), "sig").groupBy("sig").agg(F.min("text").alias("text"))
    return materialize(named.union(unnamed), "texts")


def _confirmed(pairs: DataFrame, t: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) that are linked on their full sets. The sets are made anew from the texts, and
    a text that gives another set than its class has (a repeated doc_id) is left out."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        sk, out = Sketcher(p), Batcher(schema)
        last, last_set = None, None
        for batch in text_batches(batches, 64):
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != last:
                    last_set, last = sk.shingles(ta), a
                    if set_id(last_set) != a:
                        last = None
                        continue
                other = sk.shingles(tb)
                if set_id(other) != b:
                    continue
                both = np.isin(last_set, other, assume_unique=True, kind="sort").sum()
                if 100 * both >= p.per_cent * (len(last_set) + len(other) - both) and out.add((a, b)):
                    yield out.flush()
        yield out.flush()

    half = beside(pairs, t.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b", "a", p)
    joined = beside(half, t.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a", "b", p, pairs).select("a", "b", "ta", "tb")
    return materialize(joined.mapInArrow(run, "a binary, b binary"), "links")


def _confirmed_in_blocks(found: DataFrame, t: DataFrame, p: Params) -> DataFrame:
    """The same for the blocks' lists: a block's texts come to it once each, not once for each pair."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        sk, out = Sketcher(p), Batcher(schema)
        now, sets = None, {}
        for batch in text_batches(batches, 64):
            for block, kind, a, bs, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if block != now:
                    now, sets = block, {}
                if kind == 0:
                    s = sk.shingles(text)
                    if set_id(s) == a:
                        sets[a] = s
                    continue
                one = sets.get(a)
                if one is None:
                    continue
                for b in bs:
                    other = sets.get(b)
                    if other is None:
                        continue
                    both = np.isin(one, other, assume_unique=True, kind="sort").sum()
                    if 100 * both >= p.per_cent * (len(one) + len(other) - both) and out.add((a, b)):
                        yield out.flush()
        yield out.flush()

    held = beside(found.filter("kind = 0").select("blk", F.col("a").alias("sig")), t, "sig", "blk", p)
    held = held.select("blk", F.lit(0).alias("kind"), F.col("sig").alias("a"), F.lit(None).cast("array<binary>").alias("bs"), "text")
    rows = held.unionByName(found.filter("kind = 1").withColumn("text", F.lit(None).cast("string")))
    dealt = rows.withColumn("_k", F.xxhash64("blk")).repartition("_k").sortWithinPartitions("blk", "kind", "a").drop("_k")
    return materialize(dealt.mapInArrow(run, "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """id and label, the smallest id of its component, for each end of an edge (a, b).

    Labels travel along edges and jump to their label's label, so the number of rounds
    grows with the logarithm of a component's width.
    """
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(heard, labels["id"] == heard["u"]).select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("jid"), F.col("label").alias("jlabel"))
        new = materialize(
            step.join(jump, step["label"] == jump["jid"], "left").select("id", "was", F.least("label", "jlabel").alias("label")), "labels"
        )
        discard(labels)
        done = new.filter(F.col("was") != F.col("label")).isEmpty()
        if done:
            discard(both)
            return new.select("id", "label")
        labels = new


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text).

    Words are those between the bytes 9 to 13 and 32, A-Z lower-cased; a text of fewer than
    five words is one shingle. Null, empty and blank texts have no shingle and are linked
    with nothing. component_id is the smallest doc_id of the component; kept says whether
    it is the row's own. Rows that repeat an id and its text are kept or not together. A
    null doc_id is never a component's smallest unless all its ids are null; other columns
    of `docs` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    give_back(docs.sparkSession)
    rows = materialize(sketch(docs, p), "sketch")
    classes = materialize(
        rows.filter(F.col("sig").isNotNull()).groupBy("sig")
        .agg(F.min("doc_id").alias("rep"), F.first("packed").alias("packed"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n")),
        "classes",
    )
    bands = classes.select("sig", F.posexplode("keys").alias("band", "key"))
    hubs = materialize(bands.groupBy("key").agg(F.min("sig").alias("hub"), F.count("*").alias("m")).filter("m > 1").select("key", "hub"), "hubs")
    shared = materialize(bands.join(hubs, "key").select("key", "band", "sig", "hub"), "buckets")
    discard(hubs)
    texts = _texts(shared, classes, docs, p)

    # The bands that a class shares with a hub are a first estimate of their similarity.
    met = shared.filter(F.col("sig") != F.col("hub")).select("sig", "hub").repartition("sig").groupBy("sig", "hub").agg(F.count("*").alias("times"))
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("t"), "hub"))), 1, p.hubs)  # of p.bands at most
    star = met.groupBy("sig").agg(first.alias("met")).select(F.col("sig").alias("b"), F.explode("met").alias("m")).select(F.col("m.hub").alias("a"), "b")
    best = _near_hub(star, classes, p).groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b")
    links = _confirmed(best, texts, p)
    labels = components(links)
    give_back(docs.sparkSession)

    near = _apart(shared, labels, classes, p, nearest=True).groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    more = _confirmed(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, p)
    links = links.union(more)
    labels = components(links)
    give_back(docs.sparkSession)

    more = _confirmed_in_blocks(_apart(shared, labels, classes, p, nearest=False), texts, p)
    discard(shared)
    discard(texts)
    if not more.isEmpty():
        labels = components(links.union(more))

    give_back(docs.sparkSession)
    named = classes.join(labels, classes["sig"] == labels["id"], "left").select("sig", "rep", F.coalesce("label", "sig").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = materialize(named.join(least, "label").select("sig", "component_id"), "components")
    full = rows.filter(F.col("sig").isNotNull()).select("doc_id", "n_shingles", "sig").join(of_class, "sig").select("doc_id", "n_shingles", "component_id")
    none = rows.filter(F.col("sig").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
