"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the 1- to 4-grams of a word with its edges. A text's vector is the
mean of its subwords' embeddings; a softmax over it gives the language. Both are
trained by stochastic gradient descent in numpy. A temperature fitted on rows
set aside calibrates the probability, and texts below the score that the target
precision needs are rejected. So are texts whose subwords are not typical of the
language predicted. That cut-off depends on a text's length and lies between
rows set aside under their own language, and what must be rejected: the same
rows under every other language, as if theirs had not been learned, and random
letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, trim
from .ngrams import grams, letters, text_blocks, word_codes

BITS = 16
DIM = 16
SIZES = (1, 2, 3, 4)
#: The classifier is fitted on at most so many labelled rows of each language, drawn by a hash of the id.
SAMPLE_PER_LANG = 400
#: Of each drawn row, texts are read whole; the cut-off for texts of no learned language is set on so many characters at a hashed place too.
WINDOW_CHARS = 400
#: Accepted texts must be right this often among the rows set aside for calibration.
TARGET_PRECISION = 0.95
#: At most this share of the texts set aside may be taken for no language learned.
FALSE_REJECTION = 0.001
#: The share of an unseen subword, in buckets of even share.
UNSEEN = 0.01
#: Texts set aside count whole and cut to so many characters; random texts have these lengths.
CUTS = (6, 12, 25, 50, 100, 200, 400)
RANDOM_TEXTS = 1400
NONE = "und"
#: A bucket's number as it is kept and sent: the sample lies in the driver's memory.
_BUCKET = np.uint16 if BITS <= 16 else np.uint32
#: The step for a text grows with the root of its number of subwords, up to so many.
SPREAD = 1000


@dataclass
class LanguageModel:
    langs: list[str]
    logits: np.ndarray  # of each bucket: its embedding times the softmax weights, then its log share in each language's texts
    bias: np.ndarray
    temperature: float
    reject_below: float
    typical_from: tuple[tuple[float, ...], tuple[float, ...]] = ((0.0,), (0.0,))  # logs of numbers of subwords, and the least mean log share of an accepted text of so many

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, accepted). Null or letterless: ``und``, 0, rejected."""
        if not text or not self.langs:
            return NONE, 0.0, False
        total, n = np.zeros(2 * len(self.langs)), 0
        for part in text_blocks(text, 3):
            c = word_codes(part)
            idx = grams(c, SIZES, BITS)
            n += len(idx)
            total += np.ones(len(idx), np.float32) @ self.logits.take(idx, axis=0)
        if not n:
            return NONE, 0.0, False
        p = _softmax((total[: len(self.langs)] / n + self.bias) / self.temperature)
        k = int(p.argmax())
        typical = total[len(self.langs) + k] / n >= np.interp(np.log(n), *self.typical_from)
        return self.langs[k], float(p[k]), bool(p[k] >= self.reject_below and typical)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Example:
    """A drawn row: its language, the subword buckets of its whole text with their shares, and a window of the text."""

    lang: str
    buckets: np.ndarray
    share: np.ndarray
    window: str


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of a whole text and how often each is there."""
    n = np.zeros(1 << BITS, np.int64)
    for part in text_blocks(text, 3):
        n += np.bincount(grams(word_codes(part), SIZES, BITS), minlength=1 << BITS)
    u = np.flatnonzero(n)
    return u, n[u]


def example(lang: str, text: str, window: str | None = None) -> Example:
    u, n = counted(text)
    return Example(lang, u.astype(_BUCKET), (n / max(1, n.sum())).astype(np.float32), text[:WINDOW_CHARS] if window is None else window)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> list[Example]:
    """The sample: at most ``per_lang`` labelled rows of each language that are not held out, drawn by a hash of the id.

    Whole texts are counted where they lie; the driver gets bucket counts, at most 2 ** BITS
    of them a row. Rows without a language, an id or a text are not drawn; rows that repeat
    an id count each, ties go by the text's hash. An empty table gives an empty sample.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = plain.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 40))
    at = F.pmod(F.xxhash64("id", F.lit("window")), F.greatest(F.length("text") - WINDOW_CHARS, F.lit(0)) + 1) + 1
    # by numbers first, so that texts of few rows travel
    near = rows.join(F.broadcast(counts), "lang").withColumn("share", share).where(F.col("share").cast("double") * F.col("n") < F.lit(2 * per_lang) * F.lit(float(1 << 40)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counted(t.as_py()) for t in b.column(3)]
            parts = [pa.array([x[0].astype(_BUCKET).tobytes() for x in got], pa.binary()), pa.array([np.minimum(x[1], 0xFFFFFFFF).astype(np.uint32).tobytes() for x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *parts], names=["lang", "share", "window", "buckets", "counts"])

    cut = near.select("lang", "share", F.substring("text", at.cast("int"), F.lit(WINDOW_CHARS)).alias("window"), "text").mapInArrow(count, "lang string, share long, window string, buckets binary, counts binary")
    first = cut.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("share", F.xxhash64("buckets", "counts"), "window"))).where(F.col("k") <= per_lang)
    out = []
    for r in first.orderBy("share", "k", "lang").select("lang", "buckets", "counts", "window").collect():
        n = np.frombuffer(r["counts"], np.uint32)
        out.append(Example(r["lang"], np.frombuffer(r["buckets"], _BUCKET), (n / max(1, n.sum())).astype(np.float32), r["window"]))
    return out


def train(rows: list[Example], epochs: int = 6, least_steps: int = 6000, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Fit on the sample, in more epochs where it is small. Every fifth row only calibrates. No rows: a model that rejects everything."""
    rows = [r for r in rows if len(r.buckets)]
    langs = sorted({r.lang for r in rows})
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    weights, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    data, texts = [(langs.index(r.lang), r.buckets, r.share) for r in rows], [r.window for r in rows]
    held, fit = data[::5], [d for i, d in enumerate(data) if i % 5] or data
    epochs = max(epochs, -(-least_steps // len(fit)))
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for j in rng.permutation(len(fit)):
            y, u, share = fit[j]
            step = rate * (1 - done / steps)
            done += 1
            x = share @ emb[u]
            g = _softmax(x @ weights + bias)
            g[y] -= 1
            back = weights @ g
            weights -= step * np.outer(x, g)
            bias -= 0.1 * step * g
            emb[u] -= step * min(len(u), SPREAD) ** 0.5 * np.outer(share, back)
    logits = (emb @ weights).astype(np.float32)
    held = held or fit
    z = np.array([share @ logits[u] + bias for _, u, share in held]).reshape(len(held), len(langs))
    y = np.array([y for y, _, _ in held], int)
    temps = np.geomspace(0.02, 50, 80)
    losses = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in temps] if len(y) else [0.0]
    t = float(temps[int(np.argmin(losses))]) if len(y) else 1.0
    typical = _typical(fit, len(langs))
    aside = [(y, t) for (y, _, _), t in zip(data[::5], texts[::5], strict=True)]
    return LanguageModel(langs, np.column_stack([logits, typical]), bias, t, _reject_below(_softmax(z / t), y), _typical_from(typical, aside, rng))


def _typical(fit: list[tuple], n: int) -> np.ndarray:
    """Log share of each bucket in the texts of each of ``n`` languages."""
    share, texts = np.zeros((1 << BITS, n)), np.zeros(n)
    for y, u, part in fit:
        share[u, y] += part
        texts[y] += 1
    return np.log(share / np.maximum(texts, 1) * (1 << BITS) + UNSEEN).astype(np.float32)


def _typical_from(typical: np.ndarray, texts: list[tuple[int, str]], rng: np.random.Generator) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The cut-off for each of CUTS: halfway between what must stay and what must go; where they overlap, what the former allow."""
    own = [c for c in sorted({c for _, t in texts for c in t.lower()}) if c.isalpha()] or ["a"]
    every = [chr(c) for c in np.flatnonzero(letters())]

    def word(of: list[str]) -> str:
        return "".join(of[i] for i in rng.integers(0, len(of), rng.integers(2, 11)))

    sizes, cuts = [], []
    for n in CUTS:
        stay, go, subwords = [], [], []
        for y, t in texts:
            idx = grams(word_codes(t[:n]), SIZES, BITS)
            if len(t) >= n and len(idx):
                means = typical[idx].mean(axis=0, dtype=float)
                stay.append(means[y])
                go += list(np.delete(means, y))
                subwords.append(len(idx))
        if not stay:
            continue
        for k in range(RANDOM_TEXTS // len(CUTS)):
            idx = grams(word_codes(" ".join(word(every if k % 2 else own) for _ in range(n // 3 + 1))[:n]), SIZES, BITS)
            if len(idx):
                go.append(typical[idx].mean(axis=0, dtype=float).max())
        # of few rows, the least one says little; then their spread does
        least = min(float(np.quantile(stay, FALSE_REJECTION, method="lower")), float(np.mean(stay) - 3.1 * np.std(stay)))
        most = float(np.quantile(go, 1 - FALSE_REJECTION))
        sizes.append(float(np.log(np.median(subwords))))
        cuts.append(min(least, (least + most) / 2))
    return (tuple(sizes), tuple(cuts)) if sizes else ((0.0,), (0.0,))


def _reject_below(p: np.ndarray, y: np.ndarray) -> float:
    """The least score from which on the rows set aside are right as often as the target asks."""
    if not len(y):
        return 0.0
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = (p.argmax(axis=1) == y)[order]
    share = np.cumsum(right) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= TARGET_PRECISION)
    if not len(good):
        return 1.0
    return 0.0 if good[-1] == len(y) - 1 else float(p.max(axis=1)[order][good[-1]])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted; columns of these names are replaced, all rows stay.

    Null, empty and letterless texts get ``und``, score 0 and are not accepted.
    Texts of any length are read whole, block after block. Ids are not read, so
    null and repeated ones are harmless; of equal scores the language that comes
    first by name is taken. An empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.predict(t.as_py()) for t in b.column(at)]
            cols = [*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        trim()

    return docs.select(*keep).mapInArrow(run, schema)
