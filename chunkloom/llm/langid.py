"""Language ID by word-first backoff.

A word seen in training scores by its log frequency in each language. A word never
seen falls back to its character n-grams: the longest length at which any of them
is known decides, down to single characters. A text's language is the one with the
largest sum over all its words.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, discard, emit, is_training, materialize, sampled_ids, text_batches

RUN = re.compile(r"[^\W\d_]+")  # letters, and the numerals that are not decimal digits
UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    per_class: int = 800  # training texts of each language, at most about
    longest: int = 5
    min_word: int = 2  # a word is known from so many occurrences on
    smooth: float = 0.5


@dataclass(frozen=True)
class Model:
    params: Params
    languages: list[str]
    known: list[dict[str, int]]  # row numbers: of words first, then of n-grams by length
    logs: list[np.ndarray]  # their log frequencies, a column for each language
    prior: np.ndarray


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters; signs such as ½ or ² are no letters."""
    found = RUN.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def _table(counts: list[dict[str, int]], least: int, smooth: float) -> tuple[dict[str, int], np.ndarray]:
    """Row numbers and log frequencies of the keys with `least` occurrences in all languages together."""
    total: dict[str, int] = {}
    for c in counts:
        for k, n in c.items():
            total[k] = total.get(k, 0) + n
    rows = {k: i for i, k in enumerate(k for k, n in total.items() if n >= least)}
    m = np.full((len(rows), len(counts)), smooth)
    for j, c in enumerate(counts):
        at = [(rows[k], n) for k, n in c.items() if k in rows]
        if at:
            i, n = zip(*at)
            m[list(i), j] += n
    return rows, np.log(m / m.sum(0)).astype(np.float32) if rows else m.astype(np.float32)


def fit(texts: list[str | None], langs: list[str], p: Params = Params()) -> Model:
    names = sorted(set(langs))
    at = {x: i for i, x in enumerate(names)}
    words: list[dict[str, int]] = [Counter() for _ in names]
    for t, lang in zip(texts, langs):
        words[at[lang]].update(words_of(t))
    grams: list[list[dict[str, int]]] = [[{} for _ in names] for _ in range(p.longest)]
    for i, counter in enumerate(words):
        for w, n in counter.items():
            padded = f" {w} "
            for k in range(p.longest):
                d = grams[k][i]
                for j in range(len(padded) - k):
                    g = padded[j : j + k + 1]
                    d[g] = d.get(g, 0) + n
    tables = [_table(words, p.min_word, p.smooth)] + [_table(g, p.min_word if k >= 2 else 1, p.smooth) for k, g in enumerate(grams)]
    total = np.array([max(1, sum(c.values())) for c in words], float)
    return Model(p, names, [t[0] for t in tables], [t[1] for t in tables], np.log(total / total.sum()) if names else total)


def word_scores(model: Model, new: list[str]) -> np.ndarray:
    """A row of log frequencies for each word: its own, or the mean of its known n-grams of
    the longest length that has any; zeros where not even a character is known."""
    out = np.zeros((len(new), len(model.languages)), np.float32)
    own = model.known[0]
    found: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in model.known]
    for i, w in enumerate(new):
        row = own.get(w)
        if row is not None:
            found[0][0].append(i)
            found[0][1].append(1)
            found[0][2].append(row)
            continue
        padded = f" {w} "
        for k in range(model.params.longest, 0, -1):
            get = model.known[k].get
            rows = [r for r in [get(padded[j : j + k]) for j in range(len(padded) - k + 1)] if r is not None]
            if rows:
                found[k][0].append(i)
                found[k][1].append(len(rows))
                found[k][2].extend(rows)
                break
    for (words, sizes, rows), logs in zip(found, model.logs):
        if words:
            n = np.array(sizes)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            out[words] = np.add.reduceat(logs[rows], first, axis=0) / n[:, None]
    return out


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self):
        self.index = WordIndex(None)
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.index) > self.index.limit:
            self._reset()
        ids = []
        for t in texts:
            found = words_of(t)
            ids.append(np.fromiter(map(self.index.__getitem__, found), np.int64, len(found)))
        if self.index.new:
            fresh = word_scores(self.model, self.index.new)
            self.rows = np.concatenate([self.rows, fresh])
            self.index.new = []
        out = []
        for d in ids:
            if not len(d) or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.rows[d].sum(0, dtype=np.float64) + self.model.prior
            best = int(np.argmax(total))  # ties: the first language by name
            spread = (total - total[best]) * min(1.0, 10.0 / len(d))
            out.append((self.model.languages[best], float(1.0 / np.exp(spread).sum())))
        return out


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Fit on a bounded, hash-picked sample of rows with a language whose
    crc32(doc_id) mod 5 is not 0: about per_class texts of each language. A repeated id
    teaches once. The fit runs in one task; the driver gets the model, whose words and
    n-grams are bounded by the sample."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text").alias("_text")).filter(
        F.col("_id").isNotNull() & F.col("_lang").isNotNull() & is_training(F.col("_id"))
    )
    # A table of ids: Spark broadcasts it where its size allows that (per_class ids a language).
    ids = materialize(sampled_ids(rows, "_id", "_lang", p.per_class).select("_id"), "language-sample")
    some = rows.join(ids, "_id").groupBy("_id").agg(F.min(F.struct("_lang", "_text")).alias("x")).select("_id", "x._lang", "x._text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((i, lang, t or "") for b in batches for i, lang, t in zip(*(b.column(k).to_pylist() for k in range(3)))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, _, t in got], [lang for _, lang, _ in got], p))], pa.binary())], names=["model"])

    made = some.repartition(1).mapInArrow(run, "model binary").collect()
    discard(ids)
    return pickle.loads(made[0]["model"]) if made else fit([], [], p)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the prediction's share, 0 to 1) of every row.

    Null texts and texts without a letter are `und` with score 0 (numerals such as ½ and
    ² are no letters). Repeated rows are judged alike; other columns are ignored. The share
    is of the evidence of ten words, so that long texts do not all score 1.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in text_batches(batches):
            got = scorer.predict(b.column(1).to_pylist())
            yield emit({"doc_id": b.column(0).to_pylist(), "lang_pred": [x for x, _ in got], "score": [x for _, x in got]}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
