"""URL filters: rules on host and path, and logistic regression on hashed n-grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .ngrams import codes, grams

BITS = 18
SIZES = (3, 4, 5)
#: The table of labelled URLs has at most so many rows; a larger one is cut by a hash of the URL.
MAX_LABELLED = 5_000
BLOCK_FROM = 0.5

# fixed values: words that hosts and paths of unwanted and of ordinary pages are made of
UNWANTED = "casino poker slots jackpot roulette bets betting bonus pills pharmacy viagra cialis diet porn xxx adult escorts cams loans payday debt replica rolex ads adserver banner track tracker popup clicks spam linkfarm farm warez crack keygen torrent lottery win cheap free".split()
ORDINARY = "news times daily journal library museum university school science physics history garden kitchen recipes travel hotel music film books archive docs manual forum wiki city council health clinic weather sports football energy bank market shop photo art design software code community church family blog".split()
ENDINGS = ("com", "net", "org", "info")


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains where the path starts with ``path``; the longest rule wins."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(text: str, verdict: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(host.lower(), slash + path, verdict)


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: F.Column) -> F.Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: F.Column, path: F.Column, rules: list[Rule]) -> F.Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null. Rules are few; all are tried in generated code."""
    kind = "struct<size:int,rule:string,verdict:string>"
    if not rules:
        return F.lit(None).cast(kind)
    each = []
    for r in rules:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        each.append(F.when(fits, F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.array_max(F.array(*each)).cast(kind)


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the n-grams of host and path; each part has its own seed and marked ends."""
    return np.unique(np.concatenate([grams(codes(f"\x02{part}\x03"), SIZES, BITS, seed, inside=False) for seed, part in ((1, host), (2, path))]))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_score(self, host: str, path: str) -> float:
        idx = features(host, path)
        z = self.weights.take(idx).sum() / max(1, len(idx)) ** 0.5 + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[str, str, int]], epochs: int = 8, rate: float = 0.5, decay: float = 1e-5, seed: int = 3) -> UrlModel:
    """Fit on (host, path, 1 to block or 0 to allow) by stochastic gradient descent. No rows: everything scores below the threshold."""
    w, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return UrlModel(w.astype(np.float32), -1.0)
    data = [(features(h, p), y) for h, p, y in rows]
    rng, steps, done = np.random.default_rng(seed), epochs * len(rows), 0
    for _ in range(epochs):
        for j in rng.permutation(len(data)):
            idx, y = data[j]
            step = rate * (1 - done / steps)
            done += 1
            norm = max(1, len(idx)) ** 0.5
            g = 1 / (1 + np.exp(-np.clip(w[idx].sum() / norm + bias, -30, 30))) - y
            w[idx] -= step * (g / norm + decay * w[idx])
            bias -= 0.1 * step * g
    return UrlModel(w.astype(np.float32), float(bias))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table, url and block (1 or 0): hosts and paths put together from UNWANTED and ORDINARY by rule.

    Every word takes part as a host of its own, beside a word of its list, and as a folder.
    Numbers, pages and queries stand under both labels alike.
    """
    rows = []
    for block, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, w in enumerate(words):
            for k in range(8):
                other, end = words[(i + 5 * k + 1) % len(words)], ENDINGS[(i + k) % len(ENDINGS)]
                host = (f"{w}.{end}", f"www.{w}-{other}.{end}", f"{other}{w}.{end}", f"m.{w}.{end}")[k % 4]
                path = ("", "/", f"/{w}/{i * 37 + k}", f"/en/{other}/index.html", f"/{k}/{w}.html?page=2")[(i + k) % 5]
                rows.append((f"http://{host}{path}", block))
    return spark.createDataFrame(rows, "url string, block int")


def labelled_sample(labelled: DataFrame, url_col: str = "url", label_col: str = "block") -> list[tuple[str, str, int]]:
    """(host, path, label) of at most MAX_LABELLED distinct labelled URLs, drawn by a hash of the URL before anything is grouped.

    Null URLs and labels are left out; of one URL's labels the largest counts.
    """
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("label"))
    n = rows.count()
    share = F.pmod(F.xxhash64("url", F.lit("labelled")), F.lit(1 << 40))
    near = rows.where(share.cast("double") * F.lit(float(n)) < F.lit(2.0 * MAX_LABELLED * (1 << 40))) if n > 4 * MAX_LABELLED else rows
    cut = near.groupBy("url").agg(F.max("label").alias("label")).orderBy(share, "url").limit(MAX_LABELLED)
    return [tuple(r) for r in cut.select(host_of(F.col("url")), path_of(F.col("url")), "label").collect()]


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (``allow`` | ``block``) and block_score double, null where a rule decides.

    A null URL or one without ``://`` has an empty host and path and is judged by
    the model. Of rules that fit equally long, ``block`` wins. Columns of the new
    names are replaced; every row stays, and an empty table gives an empty one.
    """
    new = ("host", "path", "rule", "verdict", "block_score")
    keep = [c for c in pages.columns if c not in new]
    by_rule = fresh(pages.columns, "_rule")
    rows = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn(by_rule, matched(F.col("host"), F.col("path"), rules))
    schema = T.StructType([*rows.schema.fields, T.StructField("block_score", T.DoubleType())])
    host_at, path_at, rule_at = (rows.columns.index(c) for c in ("host", "path", by_rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            decided = b.column(rule_at).is_valid().to_pylist()
            s = [None if d else model.block_score(h, p) for d, h, p in zip(decided, b.column(host_at).to_pylist(), b.column(path_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=schema.names)

    by_model = F.when(F.col("block_score") >= BLOCK_FROM, "block").otherwise("allow")
    out = rows.mapInArrow(run, schema)
    return out.select(*keep, "host", "path", F.col(by_rule)["rule"].alias("rule"), F.coalesce(F.col(by_rule)["verdict"], by_model).alias("verdict"), "block_score")
