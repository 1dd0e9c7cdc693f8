"""Mixture-controlled packing by deficit round-robin.

Documents are tokenised once and written to the shared folder. Then they are dealt into
slots of about `slot_tokens` tokens: a source's documents, in the order they were written,
are cut into as many runs of equal token sums as there are slots, so every slot holds
every source in its proportion, however the input was stored. Each source starts its round
at a slot of its own, or the first would hold all small sources. Within a slot documents
go by their place in their run, so all sources last to its end.

Each source is a queue with a target share of the tokens. A packing task keeps a deficit
per queue; when it fills a window it adds each queue's share of the window to its deficit
and serves queues, largest deficit first, up to their deficit, then whatever queue has
tokens, so every window is full and an overserved queue waits in later ones. The deficits
of a slot's first window are those that all slots before it leave behind: the slots' token
sums per queue say so exactly, because a slot packs all of its documents. They travel with
the documents, so a task reads those of its own slots only.

A window holds `length` tokens. What is left at a slot's end becomes sequences
of powers of two tokens, which need no padding.
"""

from __future__ import annotations

from array import array
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batcher, materialize, text_batches

#: The words that the tokenizer's model may be asked for directly: Latin letters in
#: composed form, with or without ASCII punctuation behind them (one run, one token group).
PLAIN = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)"

#: Texts on which the way by words must agree with the tokenizer before it is used.
PROBES = ("Some plain Words, all APART.", "one  two\n\nthree\tfour ", " Straße ÀÉ naïve; (x) it's don't", "A.B.,C 12 x34 5y ... !?", "tHe wOrd wOrDs, wOrD.", "été ñandú Öl über")


@dataclass(frozen=True)
class Params:
    tokenizer: str = ""  # path of a tokenizers JSON file; "" for word_bpe_49k.json of public_tokenizers
    end_id: int = 1
    length: int = 2048
    targets: tuple[tuple[str, float], ...] = ()  # (source, share); () for the corpus' own shares
    slot_tokens: int = 1 << 22
    max_openings: int = 1 << 20  # partitions x sources up to which the dealing table is broadcast
    buffer_tokens: int = 1 << 20  # tokens that a task holds before it packs windows
    known_words: int = 700_000


def tokenizer_path(p: Params) -> str:
    if p.tokenizer:
        return p.tokenizer
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others from 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(other)}


class Known(dict):
    """A cache that makes what it does not hold."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        got = self[key] = self.make(key)
        return got


class Tokens:
    """Token ids of texts, the same as the tokenizer gives for the whole text.

    The tokenizer drops white space and never joins what stands on its two sides, so a
    text's ids are those of its white-space-separated parts; a part that was seen before
    costs one look-up. A plain word goes to the BPE model itself, the rest through the
    whole tokenizer. A tokenizer that gives a text of PROBES other ids than this way does
    (it keeps capitals or white space, say) is asked for whole texts.
    """

    def __init__(self, path: str, limit: int):
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model, self.limit = self.tok.model, limit
        self.plain = re.compile(PLAIN).fullmatch
        self.odd = re.compile("[\x1c-\x1f]").search  # split() parts here, the tokenizer does not
        self.letters = str.maketrans(_byte_letters())
        self.known, self.stems = Known(self._part), Known(self._stem)
        self.whole = False
        self.whole = any(self.ids(t) != self._all(t) for t in PROBES)

    def _all(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, word: str) -> bytes:
        q = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(q)]).tobytes()

    def _part(self, part: str) -> bytes:
        m = self.plain(part)
        if m is None:
            return self._all(part)
        return self.stems[m[1].lower()] + self.stems[m[2]] if m[2] else self.stems[m[1].lower()]

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.whole or self.odd(text):
            return self._all(text)
        if len(self.known) > self.limit:
            self.known.clear()
            self.stems.clear()
        return b"".join(map(self.known.__getitem__, text.split()))


def tokenize(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, source ('' for null), part, at, n_tokens and ids (with the end id) of every row.

    `at` counts the tokens of the same source before the row in its part.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    end = np.array([p.end_id], "<u4").tobytes()

    def run(batches):
        tokens, part = Tokens(tokenizer_path(p), p.known_words), TaskContext.get().partitionId()
        out, seen = Batcher(schema), Counter()
        for b in text_batches(batches):
            for doc_id, text, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = tokens.ids(text) + end
                source, n = source or "", len(ids) // 4
                if out.add((doc_id, source, part, seen[source], n, ids), len(ids)):
                    yield out.flush()
                seen[source] += n
        yield out.flush()

    cols = (F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return docs.select(*cols).mapInArrow(run, "doc_id long, source string, part int, at long, n_tokens long, ids binary")


def deal(tokens: DataFrame, p: Params = Params()) -> tuple[DataFrame, int]:
    """The tokens with their slot and place in it (0 to 1), and the number of slots."""
    sums = materialize(tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")), "sums")
    total, rows = sums.agg(F.sum("n"), F.count("*")).first()
    slots = max(1, -(-(total or 0) // p.slot_tokens))
    own = Window.partitionBy("source")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("source", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("all"))
    turn = F.pmod(F.xxhash64("source"), F.lit(1 << 30)) / float(1 << 30)
    spot = F.pmod((F.col("before") + F.col("at")) / F.col("all") + turn, F.lit(1.0)) * slots
    slot = F.least(F.floor(spot), F.lit(slots - 1)).cast("int")
    dealt = tokens.join(F.broadcast(starts) if rows <= p.max_openings else starts, ["source", "part"])
    return dealt.select(slot.alias("slot"), (spot - slot).alias("place"), *tokens.columns), slots


def openings(dealt: DataFrame, slots: int, p: Params = Params()) -> tuple[DataFrame, np.ndarray]:
    """slot, source, its target share and its tokens in earlier slots; all tokens in earlier slots."""
    sums = materialize(dealt.groupBy("slot", "source").agg(F.sum("n_tokens").alias("n")), "slots")
    n = np.zeros(slots, np.int64)
    for r in sums.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a number a slot
        n[r["slot"]] = r["n"]
    own = Window.partitionBy("source")
    if not p.targets:
        share = F.sum("n").over(own) / float(max(1, n.sum()))
    else:
        want = dict(p.targets)
        here = [r["source"] for r in sums.select("source").distinct().filter(F.col("source").isin(*want)).collect()]
        if (every := sum(want[q] for q in here)) > 0:
            share = F.lit(0.0)
            for q in here:
                share = F.when(F.col("source") == q, F.lit(want[q] / every)).otherwise(share)
        else:
            share = F.lit(1 / max(1, sums.select("source").distinct().count()))
    before = F.sum("n").over(own.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("slot", "source", share.alias("share"), F.coalesce(before, F.lit(0)).alias("before")), np.cumsum(n) - n


class Packer:
    """Fills sequences from queues; pieces are (row, start, length, sequence, offset)."""

    def __init__(self, shares: np.ndarray, deficits: np.ndarray, first_id: int, p: Params):
        self.shares, self.deficits, self.p = shares, deficits.astype(float).copy(), p
        self.queues = [deque() for _ in shares]  # of [document, start]
        self.held = np.zeros(len(shares), np.int64)
        self.next_id = first_id

    def add(self, q: int, document: tuple) -> None:
        self.queues[q].append([document, 0])
        self.held[q] += len(document[1]) // 4

    def _take(self, q: int, n: int, offset: int, out: list) -> int:
        queue = self.queues[q]
        left = n
        while left and queue:
            document, start = queue[0]
            k = min(left, len(document[1]) // 4 - start)
            out.append((document, start, k, self.next_id, offset))
            offset, left = offset + k, left - k
            if start + k == len(document[1]) // 4:
                queue.popleft()
            else:
                queue[0][1] += k
        self.held[q] -= n - left
        self.deficits[q] -= n - left
        return n - left

    def _waiting(self) -> np.ndarray:
        """Queues that hold tokens, largest deficit first."""
        some = np.flatnonzero(self.held)
        return some[np.argsort(-self.deficits[some], kind="stable")]

    def fill(self, size: int) -> list[tuple]:
        """One sequence of `size` tokens; that many must be held."""
        self.deficits += self.shares * size
        out: list[tuple] = []
        done = 0
        for q in self._waiting():
            if self.deficits[q] < 1 or done == size:
                break
            done += self._take(q, min(size - done, int(self.deficits[q])), done, out)
        for q in self._waiting():
            if done == size:
                break
            done += self._take(q, size - done, done, out)
        self.next_id += 1
        return out

    def full(self) -> Iterator[list[tuple]]:
        """Windows while more is held than the buffer is to keep."""
        while self.held.sum() > self.p.buffer_tokens:
            yield self.fill(self.p.length)

    def rest(self) -> Iterator[list[tuple]]:
        while (n := int(self.held.sum())) > 0:
            yield self.fill(self.p.length if n >= self.p.length else 1 << (n.bit_length() - 1))


def pack(tokens: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids, doc_tokens, sequence_id, offset.

    Sequence ids are the slot's number times 2^40 and a count. A slot's rows are sorted, so
    a task that runs again gives the same ones.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])
    dealt, slots = deal(tokens, p)
    opening, before = openings(dealt, slots, p)
    first = opening.select("slot", F.lit(-1.0).alias("place"), "source", "share", "before")
    every = first.unionByName(dealt.drop("n_tokens"), allowMissingColumns=True)
    every = every.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "place", "source", "part", "at")
    shared = tokens.sparkSession.sparkContext.broadcast(before)  # a number a slot

    def run(batches):
        before, out, packer, now = shared.value, Batcher(schema), None, None

        def rows(sequences):
            for pieces in sequences:
                for (doc_id, ids, source), start, n, seq, offset in pieces:
                    cut = ids[4 * start : 4 * (start + n)]
                    if out.add((doc_id, source, start, n, cut, len(ids) // 4, seq, offset), 4 * n):
                        yield out.flush()

        for b in text_batches(batches):
            for slot, doc_id, source, ids, share, own in zip(*(b.column(i).to_pylist() for i in range(6))):
                if slot != now:
                    if packer is not None:
                        yield from rows(packer.rest())
                    packer, now, at, shares, deficits = None, slot, {}, [], []
                if share is not None:  # a slot's openings come before its documents
                    at[source] = len(at)
                    shares.append(share)
                    deficits.append(before[slot] * share - own)
                    continue
                if packer is None:
                    packer = Packer(np.array(shares), np.array(deficits), slot << 40, p)
                packer.add(at[source], (doc_id, ids, source))
                yield from rows(packer.full())
        if packer is not None:
            yield from rows(packer.rest())
        yield out.flush()

    ddl = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return every.select("slot", "doc_id", "source", "ids", "share", "before").mapInArrow(run, ddl)


def pack_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Tokenise `docs` (doc_id, text, source) and pack every token into one sequence position.

    Null and empty texts are a document of the end id alone. Repeated rows are packed as
    often as they occur; a null source counts as the source '' and shares its queue, and a
    null doc_id is carried along. An empty table gives no pieces. Other columns are ignored.
    """
    tokens = materialize(tokenize(docs, p), "tokens")
    return pack(tokens, p)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
