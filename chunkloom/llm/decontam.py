"""Benchmark decontamination: BM25 retrieval of test items, verified by overlap.

Test items form an inverted index with BM25 weights; each weight is divided by its item's
own total, so that one threshold serves all items. Every passage of every document is a
query that retrieves all items scoring at least `least_score`, by block-max WAND: lists
in item order, a bound for each list and for each block of it, and a pivot below which no
item can reach the threshold. Passages that cannot reach it are set aside first, many at
once: an item's commonest terms together weigh half the threshold at most, so its other
terms, whose lists are short, must bring the other half. Retrieved items are verified on
five-word shingles of their question and answer: a document holds an item if it has the
question, or question and answer taken together. Both shares are reported.

The counts that BM25 weighs by (items, their mean length, the items of each word) are taken
over all items once, and so is the passages' length, so that an index in several parts gives
what one index gives.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batcher, materialize, text_batches

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+")


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.75
    least_score: float = 0.6  # of an item's own score
    block: int = 16  # postings to a block
    shingle: int = 5
    least_overlap: float = 0.8
    index_bytes: int = 8 << 20  # text of the items that are in one part of the index
    parts_per_pass: int = 4  # parts that a task searches in one pass over the documents


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer, what stands before it the question; a single sentence
    is a question without answer."""
    parts = SENTENCE_END.split(text.strip())
    last = words_of(parts[-1]) if len(parts) > 1 else []
    return words_of(" ".join(parts[:-1]) if last else text), last


def _shingles(words: list[str], k: int) -> set[tuple]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items that have a word."""

    n: int
    words: int  # in all of them together
    longest: int
    df: dict[str, int]  # items that hold a word

    @staticmethod
    def of(texts: list[str]) -> Statistics:
        bags = [w for w in map(words_of, texts) if w]
        return Statistics(len(bags), sum(map(len, bags)), max(map(len, bags), default=1), dict(Counter(w for b in bags for w in set(b))))


class Index:
    """Of the items, which are all of those that the statistics are about or a part of them."""

    def __init__(self, items: list[tuple[int, str]], p: Params, about: Statistics | None = None):
        self.p = p
        items = sorted((i, t) for i, t in items if words_of(t))
        self.ids = [i for i, _ in items]
        bags = [Counter(words_of(t)) for _, t in items]
        about = about or Statistics.of([t for _, t in items])
        sizes = [sum(b.values()) for b in bags]
        n, df, mean = about.n, about.df, about.words / max(1, about.n)
        self.longest = about.longest
        own = sorted({w for b in bags for w in b})
        idf = {w: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in own}
        self.terms = {w: i for i, w in enumerate(own)}
        lists: list[list[tuple[int, float]]] = [[] for _ in own]
        essential: list[list[tuple[int, float]]] = [[] for _ in own]
        for j, (bag, size) in enumerate(zip(bags, sizes)):
            raw = {w: idf[w] * c * (p.k1 + 1) / (c + p.k1 * (1 - p.b + p.b * size / mean)) for w, c in bag.items()}
            total = sum(raw.values())
            common = p.least_score / 2
            for w in sorted(raw, key=lambda w: (-df[w], w)):
                lists[self.terms[w]].append((j, raw[w] / total))
                common -= raw[w] / total
                if common < 0:
                    essential[self.terms[w]].append((j, raw[w] / total))
        self.lists = lists
        self.bound = [max(w for _, w in x) for x in lists]
        self.block_bound = [[max(w for _, w in x[k : k + p.block]) for k in range(0, len(x), p.block)] for x in lists]
        # Essential postings of a term are a stretch of two arrays; the last term stands for unknown words.
        self.n_essential = np.array([len(x) for x in essential] + [0])
        self.first_essential = np.concatenate([[0], np.cumsum(self.n_essential)[:-1]])
        self.essential_items = np.array([j for x in essential for j, _ in x], np.int64)
        self.essential_weights = np.array([w for x in essential for _, w in x])
        self.parts = []
        for _, t in items:
            q, a = question_and_answer(t)
            self.parts.append((_shingles(q, p.shingle), _shingles(a, p.shingle), len(q), len(a)))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items that score at least the threshold on these distinct terms."""
        least, size, lists = self.p.least_score - 1e-9, self.p.block, self.lists
        at = {t: 0 for t in terms}
        out = []
        live = sorted(terms, key=lambda t: lists[t][0][0])
        while live:
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += self.bound[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            blocks, nearest = 0.0, None
            for t in live[: pivot + 1]:
                lst, k = lists[t], at[t] // size  # the block of this list in which the item would be
                while (k + 1) * size < len(lst) and lst[(k + 1) * size - 1][0] < item:
                    k += 1
                blocks += self.block_bound[t][k]
                end = lst[min((k + 1) * size, len(lst)) - 1][0] + 1
                nearest = end if nearest is None else min(nearest, end)
            if blocks < least:  # nothing in these blocks can reach it: on to the first block's end
                goal = max(item + 1, nearest)
                if pivot + 1 < len(live):
                    goal = max(item + 1, min(goal, lists[live[pivot + 1]][at[live[pivot + 1]]][0]))
            else:
                score = 0.0
                for t in live[: pivot + 1]:
                    lst, k = lists[t], at[t]
                    while k < len(lst) and lst[k][0] < item:
                        k += 1
                    at[t] = k
                    if k < len(lst) and lst[k][0] == item:
                        score += lst[k][1]
                if score >= least:
                    out.append((item, score))
                goal = item + 1
            for t in live[: pivot + 1]:
                lst, k = lists[t], at[t]
                while k < len(lst) and lst[k][0] < goal:
                    k += 1
                at[t] = k
            live = sorted((t for t in live if at[t] < len(lists[t])), key=lambda t: lists[t][at[t]][0])
        return out

    def overlaps(self, item: int, passage: list[str]) -> tuple[float, float, float]:
        """Shares of the question's, the answer's and all shingles that the passage has."""
        q, a, nq, na = self.parts[item]
        k = self.p.shingle
        have: dict[int, set[tuple]] = {}

        def found(s, n):
            n = min(n, k)
            if n not in have:
                have[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
            return sum(x in have[n] for x in s)

        fq, fa = (found(q, nq) if q else 0), (found(a, na) if a else 0)
        return fq / len(q) if q else 1.0, fa / len(a) if a else 1.0, (fq + fa) / (len(q) + len(a))

    def search(self, text: str | None) -> list[tuple[int, float, float, float]]:
        return self.search_all([text])[0]

    def search_all(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """For each text (item id, score, question overlap, answer overlap) of its verified items, each once."""
        out: list[list] = [[] for _ in texts]
        if not self.ids:
            return out
        unknown, stride, get = len(self.lists), self.longest, self.terms.get
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        # A passage is two strides long, so any run of an item's length lies whole in one. A text has a
        # passage more than it needs, so that its strides are numbered apart from the next text's.
        strides = sizes // stride + 2
        first = np.concatenate([[0], np.cumsum(strides)[:-1]])
        ids = np.fromiter((get(w, unknown) for d in words for w in d), np.int64, int(sizes.sum()))
        n = self.n_essential[ids]
        hit = np.flatnonzero(n)
        if not len(hit):
            return out
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.repeat(first, sizes)[hit] + (hit - np.repeat(starts, sizes)[hit]) // stride
        n = n[hit]
        at = np.repeat(self.first_essential[ids[hit]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.repeat(place, n) * len(self.ids) + self.essential_items[at]
        both, where = np.unique(np.concatenate([key, key - len(self.ids)]), return_inverse=True)
        bound = np.bincount(where, np.tile(self.essential_weights[at], 2))
        passages = np.unique(both[bound >= self.p.least_score / 2 - 1e-9] // len(self.ids))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for passage in passages.tolist():
            d = int(np.searchsorted(first, passage, "right")) - 1
            if d < 0:
                continue
            lo = (passage - int(first[d])) * stride
            hi = lo + 2 * stride
            terms = np.unique(ids[starts[d] + lo : min(starts[d] + hi, starts[d] + sizes[d])])
            for item, score in self.retrieve(terms[terms < unknown].tolist()):
                q, a, whole = self.overlaps(item, words[d][max(0, lo - stride) : hi + stride])
                leaked = whole >= self.p.least_overlap or (self.parts[item][0] and q >= self.p.least_overlap)
                if leaked and ((d, item) not in best or score > best[d, item][0]):
                    best[d, item] = (score, q, a)
        for (d, item), v in sorted(best.items()):
            out[d].append((self.ids[item], *v))
        return out


def _words_by_part(items: DataFrame, parts: int) -> DataFrame:
    """part, word and size of the distinct words of each item; its number of words with the first."""
    schema = pa.schema([("part", pa.int32()), ("word", pa.string()), ("size", pa.int64())])

    def run(batches):
        out = Batcher(schema)
        for b in text_batches(batches):
            for part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                for k, w in enumerate(sorted(set(words))):
                    if out.add((part, w, None if k else len(words))):
                        yield out.flush()
        yield out.flush()

    return items.select("part", "text").mapInArrow(run, "part int, word string, size long")


def indexes(benchmark: DataFrame, p: Params = Params()) -> Iterator[Index]:
    """The items' index, in as many parts as their size asks for, all by the statistics of all
    items. Null items are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // p.index_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    if parts == 1:
        rows = items.collect()
        yield Index([(r["item_id"], r["text"]) for r in rows], p, Statistics.of([r["text"] for r in rows]))
        return
    words = materialize(_words_by_part(items, parts), "benchmark-words")
    n, total, longest = words.agg(F.count("size"), F.sum("size"), F.max("size")).first()
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    by_part = materialize(words.select("part", "word").distinct().join(df, "word"), "benchmark-df")
    for k in range(parts):
        part = items.filter(F.col("part") == k).collect()  # of index_bytes of text, about; its words' counts are no more
        counts = {r["word"]: r["df"] for r in by_part.filter(F.col("part") == k).collect()}
        yield Index([(r["item_id"], r["text"]) for r in part], p, Statistics(n, total or 0, longest or 1, counts))


def _passes(benchmark: DataFrame, p: Params) -> Iterator[list]:
    """Broadcast parts of the index, as many at a time as are searched in one pass."""
    some = []
    for index in indexes(benchmark, p):
        some.append(benchmark.sparkSession.sparkContext.broadcast(index))  # of index_bytes of text
        if len(some) == p.parts_per_pass:
            yield some
            some = []
    if some:
        yield some


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of each document and test
    item that it contains: four fifths of the shingles of its question, or of question and answer.

    Null and empty texts contain nothing; an empty benchmark finds nothing. A repeated row
    reports again; items with equal texts are all reported. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for some in _passes(benchmark, p):

        def run(batches, some=some):
            out = Batcher(schema)
            for b in text_batches(batches):
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for shared in some:
                    for doc_id, hits in zip(ids, shared.value.search_all(texts)):
                        for hit in hits:
                            if out.add((doc_id, *hit)):
                                yield out.flush()
            yield out.flush()

        part = rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        found = part if found is None else found.union(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of `docs`, all columns as they are, that contain no test item."""
    at = docs.columns.index("text")
    for some in _passes(benchmark, p):

        def run(batches, some=some):
            for b in text_batches(batches):
                for shared in some:
                    clean = [not hits for hits in shared.value.search_all(b.column(at).to_pylist())]
                    b = b if all(clean) else b.filter(pa.array(clean, pa.bool_()))
                yield b

        docs = docs.mapInArrow(run, docs.schema)
    return docs
