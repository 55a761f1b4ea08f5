"""Best-fit packing planned over the histogram of piece lengths.

1. Tokenize; cut documents longer than a sequence, the shorter piece first.
2. Count pieces by length. The planner runs best-fit decreasing over counts:
   bins of one content are one class with a multiplicity, so its work depends on
   the sequence length and not on the number of documents.
3. Each piece gets its rank within its length and takes the slot the plan has
   for that rank. Ranks are two-level (bucket, then within the bucket), and a
   length has a bucket for each RANKED of its pieces, so that a frequent length
   is numbered by many tasks. Pieces that fill a sequence need neither rank nor plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BulkEncoder
from .common import fresh, save, trim

#: Pieces that one bucket of a length ranks, about.
RANKED = 50_000


@dataclass
class _Class:
    """Bins with equal content: ``count`` bins with ``free`` tokens left each; runs: (length, first rank, per bin, offset)."""

    free: int
    count: int
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)


def plan(histogram: dict[int, int], capacity: int) -> list[dict]:
    """Slots for every piece: rows of length, first_rank, bins, per_bin, first_bin, offset.

    The piece of rank first_rank + k goes to bin first_bin + k div per_bin, at
    offset + (k mod per_bin) * length. Zero or negative counts are ignored.
    """
    classes: dict[int, list[_Class]] = {}
    frees: list[int] = []

    def put(c: _Class) -> None:
        if c.free not in classes:
            classes[c.free] = []
            insort(frees, c.free)
        classes[c.free].append(c)

    def take(free: int) -> _Class:
        c = classes[free].pop()
        if not classes[free]:
            del classes[free]
            frees.remove(free)
        return c

    for length in sorted((n for n, k in histogram.items() if k > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"piece of {length} tokens; a sequence holds {capacity}")
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(frees, length)
            c = take(frees[i]) if i < len(frees) else _Class(capacity, -(-left // (capacity // length)))
            fit = c.free // length
            full = min(c.count, left // fit)
            if full < c.count:
                # bins that get a smaller share, or none
                rest, per = c.count - full, left - full * fit
                if full == 0 and per:
                    taker = _Class(c.free - per * length, 1, [*_shift(c.runs, 0), (length, rank, per, capacity - c.free)])
                    if rest > 1:
                        put(_Class(c.free, rest - 1, _shift(c.runs, 1)))
                    put(taker)
                    left, rank = 0, rank + per
                    continue
                put(_Class(c.free, rest, _shift(c.runs, full)))
            if full:
                put(_Class(c.free - fit * length, full, [*c.runs, (length, rank, fit, capacity - c.free)]))
                rank += full * fit
                left -= full * fit
    slots, first_bin = [], 0
    for free in frees:
        for c in classes[free]:
            slots += [{"length": n, "first_rank": r, "bins": c.count, "per_bin": per, "first_bin": first_bin, "offset": at} for n, r, per, at in c.runs]
            first_bin += c.count
    return slots


def _shift(runs: list[tuple[int, int, int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Runs of the bins that stand ``bins`` further on in their class."""
    return [(n, r + bins * per, per, at) for n, r, per, at in runs]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first may be shorter."""
    head = total % capacity or min(total, capacity)
    starts = [0, *range(head, total, capacity)]
    return list(zip(starts, (b - a for a, b in zip(starts, [*starts[1:], total], strict=True)), strict=True))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized pieces: id_col, piece, start, length, ids_crc32, and ids (unsigned 32-bit little-endian bytes) if asked.

    Null text counts as empty: one piece of the end id alone. Rows that repeat an
    id, or have none, are cut each for itself and cannot be told apart afterwards.
    Texts of any length are tokenized whole; an empty table gives no pieces;
    other columns are ignored.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] if with_ids else []
    end = end_id.to_bytes(4, "little")
    id_type = pa.int64() if isinstance(docs.schema[id_col].dataType, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = BulkEncoder.get(tokenizer_path)
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    for col, v in zip(out, (doc, k, start, n, zlib.crc32(part), part), strict=False):
                        col.append(v)
            types = [id_type or b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=False)], names=[f.name for f in fields])
        trim()

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def pack(parts: DataFrame, capacity: int = 1024, id_col: str = "doc_id", ranked: int = RANKED) -> DataFrame:
    """Append sequence_id and offset to the table of pieces; columns of these names are replaced.

    ``parts`` is read three times, so pass a written table. The plan has at most
    some thousands of rows whatever the input (lengths are at most ``capacity``),
    and the table of first ranks one for each ``ranked`` pieces; both are
    broadcast. Equal pieces (of repeated rows) take different slots, in any
    order. An empty table gives an empty table.
    """
    spark = parts.sparkSession
    parts = parts.select(*[c for c in parts.columns if c not in ("sequence_id", "offset")])
    planned = parts.where(F.col("length") < capacity)
    totals = {r["length"]: r["n"] for r in planned.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    names = {c: fresh(parts.columns, c) for c in ("_bucket", "_before", "_rank", "_length", "_first", "_last", "_per", "_bin", "_at")}
    c = lambda name: F.col(names[name])
    per_length = F.array(*[F.lit(max(1, -(-totals.get(n, 0) // ranked))).cast("long") for n in range(capacity)])
    planned = planned.withColumn(names["_bucket"], F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), per_length[F.col("length").cast("int")]))
    counts = planned.groupBy("length", names["_bucket"]).agg(F.count("*").alias("n")).collect()
    firsts, at = [], dict.fromkeys(totals, 0)
    for r in sorted(counts, key=lambda r: (r[0], r[1])):
        firsts.append((r[0], r[1], at[r[0]]))
        at[r[0]] += r[2]
    slots = plan(totals, capacity)
    first_df = spark.createDataFrame(firsts, f"length long, {names['_bucket']} long, {names['_before']} long")
    slot_df = spark.createDataFrame([(s["length"], s["first_rank"], s["first_rank"] + s["bins"] * s["per_bin"] - 1, s["per_bin"], s["first_bin"], s["offset"]) for s in slots], ", ".join(f"{names[x]} long" for x in ("_length", "_first", "_last", "_per", "_bin", "_at")))
    w = Window.partitionBy("length", names["_bucket"]).orderBy(id_col, "piece")
    numbered = planned.withColumn(names["_rank"], F.row_number().over(w) - 1).join(F.broadcast(first_df), ["length", names["_bucket"]]).withColumn(names["_rank"], c("_before") + c("_rank"))
    k = c("_rank") - c("_first")
    placed = numbered.join(F.broadcast(slot_df), (F.col("length") == c("_length")) & c("_rank").between(c("_first"), c("_last")))
    placed = placed.select(*parts.columns, (c("_bin") + F.floor(k / c("_per"))).cast("long").alias("sequence_id"), (c("_at") + F.pmod(k, c("_per")) * F.col("length")).cast("long").alias("offset"))
    # planned sequences count from 0 upwards, full pieces from -1 downwards
    full = parts.where(F.col("length") == capacity).select(*parts.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; one row a piece. See :func:`pieces` and :func:`pack` for edge cases."""
    return pack(save(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)
