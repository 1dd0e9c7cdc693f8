"""Toxicity: bags of character n-grams, averaged, into a linear softmax.

A word is the bag of its character n-grams (with `<` and `>` at its ends), each
hashed to a row of an embedding table. The rows of a window of words are averaged
and go through a linear two-class softmax; embeddings and softmax are trained
jointly with numpy. A word never seen in training shares the n-gram rows of its
known relatives, so misspellings and inflections score like them.

One toxic word in a long text would vanish in the text's average. A text is
therefore cut into windows of `window` words that cover all of it, and it scores
as its worst window does; training picks that window for each text, too. A word
counts once in a window, and the average is taken over `least` n-grams at least,
so that neither a repeated word nor a short last window weighs more than it says.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, discard, emit, is_training, materialize, sampled_ids, text_batches

#: A word longer than this is cut into pieces; all of them count.
PIECE = 40


@dataclass(frozen=True)
class Params:
    per_class: int = 1600  # labelled texts of each class that the model is fitted on, at most about
    n_min: int = 3
    n_max: int = 6
    buckets: int = 1 << 17
    dim: int = 8
    window: int = 8
    least: int = 100
    steps: int = 80
    seed: int = 7


@dataclass(frozen=True)
class Model:
    params: Params
    embeddings: np.ndarray  # buckets x dim
    softmax: np.ndarray  # dim x 2
    bias: float

    @property
    def gram_scores(self) -> np.ndarray:
        """The softmax is linear, so each n-gram row counts as one number: its logit difference."""
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def words_of(text: str | None) -> list[str]:
    out = (text or "").lower().split()
    if any(len(w) > PIECE for w in out):
        out = [w[i : i + PIECE] for w in out for i in range(0, len(w), PIECE)]
    return out


def grams_of(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, word by word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = ends[word] - np.arange(len(codes))
    buckets, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, p.n_max + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        if n >= p.n_min:
            ok = np.flatnonzero(left[:m] >= n)
            x = h[ok]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            buckets.append((x % np.uint64(p.buckets)).astype(np.int32))
            owners.append(word[ok])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(words))


def _window_starts(n_words: int, window: int) -> np.ndarray:
    return np.arange(0, max(1, n_words), window)


def _once(words: np.ndarray, window: int) -> np.ndarray:
    """1 where a word (of one text) is the first of its kind in its window, else 0."""
    at = np.arange(len(words)) % window
    again = np.zeros(len(words), bool)
    for lag in range(1, min(window, len(words))):
        again[lag:] |= (words[lag:] == words[:-lag]) & (at[lag:] >= lag)
    return (~again).astype(np.float64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: Iterable[str | None], labels: list[int], p: Params = Params()) -> Model:
    """Joint training on labelled texts; with no texts or one class, a model of that class's prior."""
    rng = np.random.default_rng(p.seed)
    emb = rng.normal(0, 0.1, (p.buckets, p.dim)).astype(np.float32)
    soft = rng.normal(0, 0.1, (p.dim, 2)).astype(np.float32)
    vocab: dict[str, int] = {}
    ids, kept = [], []
    for text, label in zip(texts, labels):
        words = words_of(text)
        if words:
            ids.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
            kept.append(label)
    y = np.array(kept, np.float64)
    if not len(y) or y.min() == y.max():
        prior = 4.0 if len(y) and y[0] == 1 else -4.0
        return Model(p, emb * 0, soft, prior)
    known = list(vocab)
    del vocab
    parts = [grams_of(known[i : i + 4096], p) for i in range(0, len(known), 4096)]
    grams, per_word = np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
    n_words = len(known)
    del parts, known
    gram_at = np.concatenate([[0], np.cumsum(per_word)])
    # Words in groups whose n-grams are summed together, so that no step holds a number for every n-gram at once.
    groups = [(i, min(i + 16384, n_words)) for i in range(0, n_words, 16384)]
    flat = np.concatenate(ids)
    once = np.concatenate([_once(d, p.window) for d in ids])
    starts, doc_first = [], []
    at = n_win = 0
    for d in ids:
        s = _window_starts(len(d), p.window)
        doc_first.append(n_win)
        starts.append(s + at)
        at, n_win = at + len(d), n_win + len(s)
    starts = np.concatenate(starts)
    doc_first = np.array(doc_first)
    doc_windows = np.diff(np.append(doc_first, n_win))
    ends = np.append(starts[1:], len(flat))
    size = np.maximum(p.least, np.add.reduceat(per_word[flat] * once, starts))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    owner = np.repeat(np.arange(len(y)), doc_windows)
    mean_e, mean_s = np.zeros_like(emb), np.zeros_like(soft)
    sq_e, sq_s = np.zeros_like(emb), np.zeros_like(soft)
    bias = mean_b = sq_b = 0.0
    warm = p.steps // 5

    def step(x, g, m, v, t, rate):
        m *= 0.9
        m += 0.1 * g
        v *= 0.99
        v += 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    for t in range(1, p.steps + 1):
        diff = soft[:, 1] - soft[:, 0]
        gram_score = emb @ diff
        word_score = np.concatenate([np.add.reduceat(gram_score[grams[gram_at[i] : gram_at[j]]], gram_at[i:j] - gram_at[i]) for i, j in groups])
        logit = np.add.reduceat(word_score[flat] * once, starts) / size + bias
        if t <= warm:  # the label holds for every window of a text
            pick = np.arange(n_win)
            w = (weight / doc_windows)[owner]
        else:  # the label holds for the worst window; of clean texts a random one counts, too
            best = np.maximum.reduceat(logit, doc_first)
            hit = np.flatnonzero(logit == best[owner])
            worst = hit[np.unique(owner[hit], return_index=True)[1]]
            clean = np.flatnonzero(y == 0)
            extra = doc_first[clean] + rng.integers(0, doc_windows[clean])
            pick = np.concatenate([worst, extra])
            w = np.concatenate([weight, weight[clean] * 0.3])
        err = (_sigmoid(logit[pick]) - y[owner[pick]]) * w
        coef = err / size[pick]
        span = ends[pick] - starts[pick]
        words = np.repeat(starts[pick] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        by_word = np.bincount(flat[words], np.repeat(coef, span) * once[words], minlength=n_words)
        used = np.flatnonzero(by_word)
        k = per_word[used]
        c = np.zeros(p.buckets)
        for i in range(0, len(used), 16384):
            u, m = used[i : i + 16384], k[i : i + 16384]
            where = np.repeat(gram_at[u] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            c += np.bincount(grams[where], np.repeat(by_word[u], m), minlength=p.buckets)
        grad_diff = c @ emb
        step(emb, (c[:, None] * diff[None, :]).astype(np.float32), mean_e, sq_e, t, 0.1)
        step(soft, np.stack([-grad_diff, grad_diff], 1).astype(np.float32), mean_s, sq_s, t, 0.1)
        g = err.sum()
        mean_b, sq_b = 0.9 * mean_b + 0.1 * g, 0.99 * sq_b + 0.01 * g * g
        bias -= 0.1 * (mean_b / (1 - 0.9**t)) / (np.sqrt(sq_b / (1 - 0.99**t)) + 1e-8)
    return Model(p, emb, soft, float(bias))


class Scorer:
    """Scores texts; the n-gram sums of words seen so far are kept, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.grams = model, model.gram_scores
        self._reset()

    def _reset(self):
        self.index = WordIndex(None)
        self.sums, self.counts = np.zeros(0), np.zeros(0, np.int64)

    def scores(self, texts: list[str | None]) -> list[float]:
        if len(self.index) > self.index.limit:
            self._reset()
        ids = []
        for t in texts:
            words = words_of(t)
            ids.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        if self.index.new:
            grams, per_word = grams_of(self.index.new, self.model.params)
            cum = np.concatenate([[0.0], np.cumsum(self.grams[grams])])
            at = np.concatenate([[0], np.cumsum(per_word)])
            self.sums = np.concatenate([self.sums, cum[at[1:]] - cum[at[:-1]]])
            self.counts = np.concatenate([self.counts, per_word])
            self.index.new = []
        out = []
        for d in ids:
            if not len(d):
                out.append(float(_sigmoid(self.model.bias)) if self.model.bias < 0 else 0.0)
                continue
            starts = _window_starts(len(d), self.model.params.window)
            once = _once(d, self.model.params.window)
            size = np.maximum(self.model.params.least, np.add.reduceat(self.counts[d] * once, starts))
            logit = np.add.reduceat(self.sums[d] * once, starts) / size
            out.append(float(_sigmoid(logit.max() + self.model.bias)))
        return out


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit on a bounded, hash-picked sample of labelled rows whose crc32(doc_id) mod 5 is not 0.

    `docs` has doc_id and text; `labels` doc_id and toxic. Rows with a null id or
    label teach nothing, a repeated id once. The bounded sample, about 2 x per_class texts, is fitted in one task,
    whose worker has more memory to itself than a driver; the driver gets the model.
    """
    lab = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & is_training(F.col("_id")))
    )
    # A table of ids: Spark broadcasts it where its size allows that (per_class ids a class).
    ids = materialize(sampled_ids(lab, "_id", "_y", p.per_class), "toxicity-sample")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(ids, "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((i, t or "", y) for b in batches for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3)))), key=lambda r: r[:2])
        m = fit([t for _, t, _ in got], [y for _, _, y in got], p)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (m.embeddings.tobytes(), m.softmax.tobytes())] + [pa.array([m.bias])], names=["e", "s", "b"])

    made = rows.repartition(1).mapInArrow(run, "e binary, s binary, b double").collect()
    discard(ids)
    if not made:
        return fit([], [], p)
    r = made[0]
    return Model(p, np.frombuffer(r["e"], np.float32).reshape(p.buckets, p.dim), np.frombuffer(r["s"], np.float32).reshape(p.dim, 2), r["b"])


def _slices(batches, field):
    for b in text_batches(batches):
        yield b, b.column(field).to_pylist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) for every row.

    Null and empty texts get the score of no evidence, below 0.5; repeated rows
    score alike; other columns of `docs` are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b, texts in _slices(batches, 1):
            s = scorer.scores(texts)
            yield emit({"doc_id": b.column(0).to_pylist(), "score": s, "predicted": [int(x >= 0.5) for x in s]}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score is below 0.5."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b, texts in _slices(batches, at):
            yield b.filter(pa.array([x < 0.5 for x in scorer.scores(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
