"""Secret scans: fixed formats, and character Markov models for what has none.

Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples. Labelled random: the values of fixed-format
secrets, and strings drawn evenly from each alphabet that keys are written in (their
transition counts are known without drawing). Labelled ordinary: the corpus' words, alone and
put together to identifiers with separators, capitals and numbers. A token whose
log-likelihood ratio says random is a secret, too. Everything is DataFrame functions: the
tokens' scores come from a table of transition ratios that is a literal of the plan (its size
is the alphabet's square).
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

# The formats that the scan must find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that have 24 characters
BASE = ("assign", "access", "hex")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABET = LOWER + UPPER + DIGITS + "+/_=-"
SIZE = len(ALPHABET) + 1
#: What random keys are written in: hexadecimal, base 32, 36, 62 and 64.
KEY_ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "-_")
#: A token: a whole run of the alphabet of 16 characters or more that no other letter or digit
#: touches, with a letter in it (the scan for personal data judges numbers).
TOKEN = r"(?<![\p{L}\p{N}+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+(?![\p{L}\p{N}])"
WORD = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z][a-z]{2,19}+(?![\p{L}\p{N}+/_=-])"


@dataclass(frozen=True)
class Params:
    sample: int = 4000  # documents that the models are trained on, at most about
    smooth: float = 0.5
    per_alphabet: float = 20000.0  # transitions that each key alphabet counts as
    least_ratio: float = 20.0  # nats by which random must be likelier
    least_mean: float = 1.6  # and nats a character


@dataclass(frozen=True)
class Model:
    ratios: list[float]  # by 1 + previous * SIZE + next; [] if a class had no sample


def _steps(token: Column) -> Column:
    """Numbers of a token's transitions; none for one of fewer than two characters. A character
    beyond the alphabet has the number 0."""

    def pairs(codes):
        return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a * SIZE + b)

    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.when(F.length(token) >= 2, spans.let(codes, pairs)).otherwise(F.array().cast("array<int>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with the columns assign, access and hex, failing matches dropped."""
    found = spans.with_spans(docs, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX})
    return (
        found.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], "^" + ASSIGN, 2)) >= 6))
        .withColumn("access", F.filter("access", lambda x: x["e"] - x["s"] >= 20))
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _identifiers(words: Column) -> Column:
    """Every word, and with the word after it (of the sorted distinct ones) an identifier in one of eight styles."""
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 64)))

    def put(a, b, i):
        number, small = (1900 + i * 37 % 150).cast("string"), (i * 7 % 100).cast("string")
        styles = (
            F.concat_ws("_", F.lower(a), F.lower(b)), F.concat_ws("_", F.lower(a), F.lower(b), small), F.concat(F.lower(a), title(b)), F.concat_ws("-", F.lower(a), F.lower(b), number),
            F.concat_ws("_", F.upper(a), F.upper(b)), F.concat(title(a), title(b), small), F.concat_ws("/", F.lower(a), F.lower(b)), F.concat_ws("-", number, small, F.lower(a)),
        )
        return F.element_at(F.array(*styles), (i % len(styles) + 1).cast("int"))

    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(words) > 1, F.concat(words, F.transform(pairs, lambda x, i: put(x["a"], x["b"], i)))).otherwise(words)


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Transition counts of a bounded, hash-picked sample of documents (by the md5 of the id, so
    a row with a null id teaches nothing).

    Labelled random: the key alphabets, and the sample's assigned values of eight characters with
    a digit and its access and hex keys. Labelled ordinary: the sample's distinct words and
    identifiers made of them. With no words the model adds no spans.
    """
    docs = _texts(docs)
    n = docs.count()
    spot = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
    some = base_spans(docs.filter(spot < min(1.0, p.sample / max(1, n)) * 16**7))
    values = F.concat(
        F.filter(F.transform("assign", lambda x: F.regexp_extract(x["m"], "^" + ASSIGN, 2)), lambda v: v.rlike("[0-9]") & (F.length(v) >= 8)),
        F.transform("access", lambda x: x["m"]), F.transform("hex", lambda x: x["m"])
    )
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    some = some.select(F.array(F.struct(F.lit(1).alias("y"), values.alias("t")), F.struct(F.lit(0).alias("y"), spans.let(words, _identifiers).alias("t"))).alias("both"))
    tokens = some.select(F.explode("both").alias("x")).select("x.y", F.explode("x.t").alias("t"))
    steps = tokens.select("y", F.explode(_steps(F.col("t"))).alias("k"))
    counts = Counter({(r["y"], r["k"]): float(r["n"]) for r in steps.groupBy("y", "k").agg(F.count("*").alias("n")).collect()})  # at most 2 * SIZE**2 rows
    if not any(y == 0 for y, _ in counts):
        return Model([])
    for letters in KEY_ALPHABETS:
        codes = [ALPHABET.index(c) + 1 for c in letters]
        for a in codes:
            for b in codes:
                counts[1, a * SIZE + b] += p.per_alphabet / len(codes) ** 2
    ratios = []
    row = {(y, a): sum(counts[y, a * SIZE + b] for b in range(SIZE)) for y in (0, 1) for a in range(SIZE)}
    for a in range(SIZE):
        for b in range(SIZE):
            lp = [math.log((counts[y, a * SIZE + b] + p.smooth) / (row[y, a] + p.smooth * SIZE)) for y in (0, 1)]
            ratios.append(round(lp[1] - lp[0], 6))
    return Model(ratios)


def likelihood_ratio(token: Column, model: Model) -> Column:
    table = F.from_json(F.lit(json.dumps(model.ratios)), "array<double>")
    return F.aggregate(_steps(token), F.lit(0.0), lambda acc, k: acc + F.get(table, k))


def is_random(token: Column, model: Model, p: Params = Params()) -> Column:
    return likelihood_ratio(token, model) >= F.greatest(F.lit(p.least_ratio), F.length(token) * p.least_mean)


def scan(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, assign, access, hex and markov: arrays of spans (s, e, m) in code points.

    A null text is empty. Spans of a kind do not overlap; markov ones overlap no other.
    Rows that repeat are scanned alike; other columns of `docs` are ignored.
    """
    found = base_spans(_texts(docs))
    if model.ratios:
        found = spans.with_spans(found, "text", {"markov": TOKEN})
        base = F.concat("assign", "access", "hex")
        random = lambda x: is_random(x["m"], model, p)
        found = found.withColumn("markov", F.filter(spans.apart_from(F.col("markov"), base), random))
    else:
        found = found.withColumn("markov", spans.none())
    return found.select("doc_id", *BASE, "markov")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' hash and all spans as text."""
    tags = [spans.tagged(F.col(k), k, i) for i, k in enumerate(BASE)]
    every = F.concat(*tags, spans.tagged(F.col("markov"), "markov", len(BASE)))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(spans.joined(F.concat(*tags)), 256).alias("base_sha256"), spans.joined(every).alias("spans")
    )
