"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models over bytes, one of URLs that a rule allows and
one of those that a rule blocks, give each URL a length-normalised difference of
log-likelihoods. Every order is smoothed by the one below it: the estimate of
order k is (count + strength x estimate of order k - 1) / (context count +
strength), down to a uniform one. Counts come from every ruled URL, one row of
a distributed table for each context and each byte in it, named by 64-bit
hashes, so the table grows with the input. Distinct URLs are dealt into blocks
of bounded size; a block asks once for each count that it needs, and is scored
with those alone. The difference is calibrated by the mean and variance that it
has on ruled URLs of either class, over all of them.

Null and malformed URLs have an empty host and path and fit no rule; they are
scored by their bytes (none: the prior). If no URL is blocked by a rule, or
none is allowed, there is nothing to compare and the verdict is allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akshara.llm._bytes import blocks, mix, utf8
from akshara.llm._frames import checkpointed, field, partitions, rowed, unrowed

#: (host and path, verdict); the path starts at the first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER, STRENGTH = 5, 4.0
#: Bytes of distinct URLs in a block, on average.
BLOCK = 1 << 20
#: Tells the hash of a context from those of bytes in contexts.
CONTEXT = np.uint64(0x9E3779B97F4A7C15)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and what it says, else nulls; a rule fits its host and all subdomains if the path starts with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def names(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each order and byte: the hash of the byte in its context, and that of the context."""
    n = len(buf)
    first = np.repeat(offsets[:-1], np.diff(offsets))
    context = np.zeros(n, np.uint64)
    seen, within = np.zeros((order + 1, n), np.int64), np.zeros((order + 1, n), np.int64)
    value = buf.astype(np.uint64) + np.uint64(1)
    for k in range(order + 1):
        if k:
            back = np.arange(n) - k
            byte = np.where(back >= first, value[np.maximum(back, 0)], np.uint64(0))  # 0: before the start
            context = mix(context * np.uint64(263) + byte + np.uint64(k))
        within[k] = mix(context ^ CONTEXT).view(np.int64)
        seen[k] = mix(context * np.uint64(263) + value).view(np.int64)
    return seen, within


def _counts(name: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names and the sums of their counts, a column each."""
    every, at = np.unique(name, return_inverse=True)
    return every, np.stack([np.bincount(at, c, len(every)).astype(np.int64) for c in n])


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.array(batch.column("accepted").to_pylist(), np.int64)
            times = batch.column("n").to_numpy()
            buf, offsets = utf8(batch.column("url"))
            for i, j in blocks(offsets, 1 << 20):
                part = offsets[i : j + 1] - offsets[i]
                seen, within = names(buf[offsets[i] : offsets[j]], part, order)
                own, n = (np.tile(np.repeat(x[i:j], np.diff(part)), 2 * (order + 1)) for x in (side, times))
                every, total = _counts(np.concatenate([seen.ravel(), within.ravel()]), np.stack([n * (own == c) for c in (0, 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(total[0]), pa.array(total[1])], ["name", "n0", "n1"])

    return run


def _needs(order: int):
    """The distinct names in each block's URLs; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column("block").to_numpy()
            buf, offsets = utf8(batch.column("url"))
            cut = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which)) if len(which) else [0]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                for i, j in blocks(offsets[lo : hi + 1], 1 << 20):
                    i, j = lo + i, lo + j
                    every = np.unique(np.concatenate(names(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), which[lo])), pa.array(every)], ["block", "name"])

    return run


def log_likelihood(buf: np.ndarray, offsets: np.ndarray, every: np.ndarray, counts: np.ndarray, order: int, strength: float) -> np.ndarray:
    """Mean log-likelihood of each row's bytes under each class; every: sorted names, counts: a row of them for each class."""
    seen, within = names(buf, offsets, order)

    def of(name: np.ndarray) -> np.ndarray:
        if not len(every):
            return np.zeros((2, len(name)))
        at = np.minimum(np.searchsorted(every, name), len(every) - 1)
        return np.where(every[at] == name, counts[:, at], 0)

    edges = offsets[:-1]
    out = np.zeros((2, len(edges)))
    size = np.diff(offsets)
    p = np.full((2, len(buf)), 1 / 256)
    for k in range(order + 1):
        p = (of(seen[k]) + strength * p) / (of(within[k]) + strength)
    for c in (0, 1):
        total = np.concatenate([[0.0], np.cumsum(np.log(p[c]))])
        out[c] = (total[offsets[1:]] - total[edges]) / np.maximum(size, 1)
    return out


def _score(order: int, strength: float):
    def run(urls: pa.Table, model: pa.Table) -> pa.Table:
        every = model.column("name").to_numpy()
        by = np.argsort(every)
        counts = np.stack([model.column(c).to_numpy() for c in ("n0", "n1")]).astype(np.float64)
        every, counts = every[by], counts[:, by]
        column = urls.column("url").combine_chunks()
        buf, offsets = utf8(column)
        out = np.zeros(len(offsets) - 1)
        for i, j in blocks(offsets, 1 << 20):
            ll = log_likelihood(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], every, counts, order, strength)
            out[i:j] = ll[1] - ll[0]
        return pa.table({"url": column, "ruled": urls.column("ruled"), "n": urls.column("n"), "ratio": out})

    return run


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """All columns of pages and host, path, rule, verdict, ratio (the models' difference) and score (calibrated probability that the URL is acceptable).

    rules: a short list, as it becomes part of the plan. New columns replace
    old ones of their names.
    """
    spark = pages.sparkSession
    url = field(url_col).cast("string")
    host, path = host_and_path(url)
    rows = rowed(pages, url=url, host=host, path=path)
    rule, ruled = rule_and_verdict(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    urls = rows.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.first("ruled").alias("ruled"), F.count("*").alias("n"))
    urls = checkpointed(urls)
    known = urls.where("ruled is not null").select("url", (F.col("ruled") == "allow").cast("int").alias("accepted"), "n")
    table = known.mapInArrow(_count(order), "name long, n0 long, n1 long").groupBy("name").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n_blocks = 1 + (urls.agg(F.sum(F.octet_length("url"))).first()[0] or 0) // BLOCK
    dealt = urls.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(n_blocks)))
    needs = dealt.select("block", "url").repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(_needs(order), "block long, name long").distinct()
    model = needs.join(table, "name")
    scored = dealt.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(_score(order, strength), "url string, ruled string, n long, ratio double")
    scored = checkpointed(scored)
    stats = {r.ruled: r for r in scored.where("ruled is not null").groupBy("ruled").agg(F.sum(F.col("ratio") * F.col("n")).alias("s"), F.sum(F.col("ratio") * F.col("ratio") * F.col("n")).alias("q"), F.sum("n").alias("n")).collect()}
    both = len(stats) == 2
    slope, middle = 0.0, 0.0
    if both:
        a, b = stats["allow"], stats["block"]
        means = [r.s / r.n for r in (a, b)]
        spread = max((a.q - a.n * means[0] ** 2 + b.q - b.n * means[1] ** 2) / (a.n + b.n), 1e-9)
        slope, middle = (means[0] - means[1]) / spread, sum(means) / 2
    rows = rows.withColumn("url", F.coalesce("url", F.lit("")))
    scored = rows.join(scored.select("url", "ratio"), "url")
    score = 1 / (1 + F.exp(-(F.col("ratio") - middle) * slope)) if both and math.isfinite(slope) else F.lit(1.0)
    out = scored.withColumn("score", score).withColumn("verdict", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "allow").otherwise("block")))
    return unrowed(out, pages.columns, ["host", "path", "rule", "verdict", "ratio", "score"])
