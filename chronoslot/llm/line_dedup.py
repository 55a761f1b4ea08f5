"""Line deduplication by site-relative frequency; DataFrame functions only.

A line is boilerplate of a host when the pages of the host that hold it, divided
by all pages of the host, exceed a ratio.

On a host of fewer than 1 / ratio pages every line exceeds the ratio. All its
pages are then made of such lines alone and stay as they are, so these hosts are
left out from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, save

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.1
#: The table of boilerplate lines is broadcast up to so many lines (16 bytes each); beyond, it is joined by shuffle.
BROADCAST_LINES = 1_000_000


def line_keys(text: F.Column) -> F.Column:
    """Distinct 64-bit keys of a text's lines, without the spaces around them; blank lines have none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """host, line_key, pages, host_pages of each line over the ratio, of hosts with 1 / ratio pages or more.

    A null host is a host of its own. A line counts once a page, a repeated row
    is a page of its own. Null and empty texts are pages without lines. An empty
    table gives no lines.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))
    totals = docs.groupBy(host.alias("host")).agg(F.count("*").alias("host_pages")).where(F.col("host_pages") * ratio >= 1)
    lines = docs.select(host.alias("host"), F.explode(line_keys(F.col(text_col))).alias("line_key"))
    pages = lines.groupBy("host", "line_key").agg(F.count("*").alias("pages"))
    return pages.join(totals, "host").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text; columns and rows stay as they were.

    A text made of boilerplate lines alone is a copied page and not a page's
    frame: it stays whole, for deduplication to judge. Texts without boilerplate
    lines, null and empty ones included, come back unchanged. Repeated rows count
    as pages of their own; ids are not read. Texts of any length are read whole.
    An empty table gives an empty one. With ``counts``, lines_dropped long is
    appended (and replaces a column of that name).
    """
    own, at, rest = (fresh(docs.columns, c) for c in ("_keys", "_host", "_kept"))
    found = boilerplate(docs, host_col, text_col, ratio).groupBy("host").agg(F.collect_list("line_key").alias(own)).withColumnRenamed("host", at)
    # a host has at most its mean number of lines a page / ratio keys. Written, so that skew handling can split a hot host's rows
    drops = save(found, "boilerplate")
    if (drops.agg(F.sum(F.size(own))).first()[0] or 0) <= BROADCAST_LINES:
        drops = F.broadcast(drops)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))
    joined = docs.join(drops, host == F.col(at), "left")
    trimmed = lambda x: F.btrim(x, F.lit(" \t\r"))
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(own), F.xxhash64(trimmed(x))) | (trimmed(x) == ""))
    joined = joined.withColumn(rest, F.when(F.col(own).isNotNull() & F.arrays_overlap(line_keys(F.col(text_col)), F.col(own)), kept))
    blank = F.forall(F.col(rest), lambda x: trimmed(x) == "")
    changed = F.col(rest).isNotNull() & ~blank
    text = F.when(changed, F.array_join(F.col(rest), "\n")).otherwise(F.col(text_col))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        n = F.when(changed, F.size(lines) - F.size(rest)).otherwise(0)
        out = [c for c, name in zip(out, docs.columns, strict=True) if name != "lines_dropped"] + [n.cast("long").alias("lines_dropped")]
    return joined.select(*out)
