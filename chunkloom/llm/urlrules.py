"""URL filters: a rule list, and association rules for what the list leaves open.

Spark's FP-growth mines combinations of URL tokens together with a row's label. Rules
that end in the block label and pass the support, confidence and lift thresholds are
kept, all but those that say nothing new: wherever such a rule fires, a kept rule with
fewer tokens and no less confidence fires too. They match by inverted index: each rule is
filed under its rarest token, a URL looks up its tokens, and a rule found that way fires
if the URL has all of its tokens. The index is a literal of the plan, cut into buckets by
the token's crc32 so that a look-up meets a few tokens only, and judging a URL is one
projection; an index that outgrows a literal is joined.

Tokens that occur in the same labelled URLs (the labels of one host, the segments of one
template) are one item while rules are mined, as no rule can tell them apart; a URL has the
item if it has one of the tokens. So a site whose URLs share many tokens costs one item.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rule list (host and path, verdict).
LIST = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BLOCK = "label=block"
#: An index of so many characters of JSON is a literal of the plan; a larger one is a table.
LITERAL = 1 << 20


@dataclass(frozen=True)
class Params:
    support: float = 0.002  # of all labelled URLs
    least_urls: int = 8  # and so many of them at least
    confidence: float = 0.6
    lift: float = 1.5
    partitions: int = 12


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; empty for null or without `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2), part(3)


def listed(host: Column, path: Column, rules=LIST) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: host labels, path segments with digits as 0, names of query arguments."""
    named = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(
        F.concat(
            named("h:", F.split(host, r"\.")),
            named("p:", F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))),
            named("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        )
    )


@dataclass(frozen=True)
class Model:
    index: dict[str, list[dict]]  # item -> rules filed under it
    items: dict[str, str] = field(default_factory=dict)  # token -> its item, if that is another token


def minimal(rules: Iterable[tuple[list[str], float]], freq: dict[str, int]) -> dict[str, list[dict]]:
    """The index of the rules (tokens, confidence), which come by their number of tokens,
    without those that contain a kept rule of no less confidence."""
    index: dict[str, list[dict]] = {}
    sets: dict[str, list[tuple[frozenset, float]]] = {}
    for tokens, sure in rules:
        own = frozenset(tokens)
        if any(c >= sure and kept <= own for t in tokens for kept, c in sets.get(t, ())):
            continue
        rarest = min(tokens, key=lambda t: (freq.get(t, 0), t))
        index.setdefault(rarest, []).append({"tokens": list(tokens), "confidence": sure})
        sets.setdefault(rarest, []).append((own, sure))
    return index


def mine(urls: DataFrame, p: Params = Params()) -> Model:
    """Rules from labelled URLs (columns url, block boolean), mined from all of them.

    Rows with a null label teach nothing. Ties between rules go by their tokens, so the
    model is the same in every run.
    """
    least = lambda n: max(p.support, p.least_urls / n)
    parts = urls.filter(F.col("block").isNotNull()).select(*[c.alias(n) for c, n in zip(url_parts(F.col("url")), "hpq")], "block")
    parts = parts.select(url_tokens(F.col("h"), F.col("p"), F.col("q")).alias("tokens"), "block")
    n = parts.count()
    if n == 0:
        return Model({})
    items = same_rows(parts.select("tokens"), math.ceil(min(1.0, least(n)) * n - 1e-9))
    mapped = item_of(F.col("tokens"), items)
    baskets = parts.select(F.concat(mapped, F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    fitted = FPGrowth(itemsCol="items", minSupport=min(1.0, least(n)), minConfidence=p.confidence, numPartitions=p.partitions).fit(baskets)
    rules = (
        fitted.associationRules.filter((F.element_at("consequent", 1) == BLOCK) & (F.col("lift") >= p.lift))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence").orderBy(F.size("tokens"), "tokens")
    )
    # Both come in full: frequent tokens are few (1 / support by a URL's tokens at most), rules pass one by one.
    freq = {r["t"]: r["n"] for r in fitted.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("t"), F.col("freq").alias("n")).collect()}
    index = minimal(((r["tokens"], r["confidence"]) for r in rules.toLocalIterator(prefetchPartitions=True)), freq)
    named = {t for own in index.values() for r in own for t in r["tokens"]}
    return Model(index, {t: i for t, i in items.items() if i in named})


def same_rows(rows: DataFrame, least: int) -> dict[str, str]:
    """Tokens of `least` rows or more that occur in just the rows that another one does, and the
    smallest such token. Rows are told apart by their tokens: equal rows hold the same ones."""
    held = rows.groupBy("tokens").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("tokens").cast("decimal(38,0)"))
    in_rows = held.select("n", "key", F.xxhash64(F.lit(5), "tokens").cast("decimal(38,0)").alias("key2"), F.explode("tokens").alias("t"))
    marks = in_rows.groupBy("t").agg(F.sum("n").alias("n"), F.sum("key").alias("a"), F.sum("key2").alias("b")).filter(F.col("n") >= least)
    groups = marks.groupBy("n", "a", "b").agg(F.min("t").alias("item"), F.collect_list("t").alias("ts")).filter(F.size("ts") > 1)  # frequent tokens are few
    return {t: r["item"] for r in groups.select("item", "ts").collect() for t in r["ts"] if t != r["item"]}


def _bucketed(pairs: dict, size: int = 4) -> list[dict]:
    out: list[dict] = [{} for _ in range(max(1, len(pairs) // size))]
    for k, v in pairs.items():
        out[zlib.crc32(k.encode()) % len(out)][k] = v
    return out


def _looked_up(key: Column, buckets: list[dict], kind: str) -> Column:
    """What the buckets hold for a string, or null."""
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")
    return F.try_element_at(F.get(table, (F.crc32(key.cast("binary")) % len(buckets)).cast("int")), key)


def item_of(tokens: Column, items: dict[str, str]) -> Column:
    """The distinct items of the tokens."""
    if not items:
        return tokens
    buckets = _bucketed(items)
    return F.array_distinct(F.transform(tokens, lambda t: F.coalesce(_looked_up(t, buckets, "string"), t)))


def confidence(tokens: Column, model: Model) -> Column:
    """The highest confidence of the rules that fire on the items, 0 if none does."""
    if not model.index:
        return F.lit(0.0)
    buckets = _bucketed(model.index)
    found = F.transform(tokens, lambda t: _looked_up(t, buckets, "array<struct<tokens:array<string>,confidence:double>>"))
    filed = F.flatten(F.filter(found, lambda x: x.isNotNull()))
    fired = F.filter(filed, lambda r: F.forall(r["tokens"], lambda t: F.array_contains(tokens, t)))
    return F.aggregate(fired, F.lit(0.0), lambda best, r: F.greatest(best, r["confidence"]))


def with_confidence(rows: DataFrame, model: Model, literal: int = LITERAL) -> DataFrame:
    """rows (with a column tokens) and their confidence."""
    rows = rows.withColumn("tokens", item_of(F.col("tokens"), model.items))
    if len(json.dumps(model.index)) <= literal:
        return rows.withColumn("confidence", confidence(F.col("tokens"), model))
    filed = [(t, x["tokens"], x["confidence"]) for t, own in model.index.items() for x in own]
    kind = pa.schema([("token", pa.string()), ("needs", pa.list_(pa.string())), ("sure", pa.float64())])
    rules = rows.sparkSession.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*filed), kind)], schema=kind))
    tried = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(rules, "token")
    fired = tried.filter(F.forall("needs", lambda t: F.array_contains("tokens", t))).groupBy("tokens").agg(F.max("sure").alias("sure"))
    return rows.join(fired, "tokens", "left").withColumn("confidence", F.coalesce("sure", F.lit(0.0)))


def judge(pages: DataFrame, model: Model, rules=LIST, literal: int = LITERAL) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence for every row.

    The list's longest fitting rule decides; without one, the mined rules do: block if one
    fires, else allow. A null url, or one without `://`, has an empty host and path, fits no
    rule and is allowed. Repeated rows are judged alike, an empty table gives no rows, and a
    very long url is judged whole; other columns are ignored.
    """
    host, path, query = url_parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
    rule, says = listed(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), url_tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"))
    rows = with_confidence(rows, model, literal)
    verdict = F.coalesce("says", F.when(F.col("confidence") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
