"""Toxicity: a lexicon trie under Levenshtein automata, and context-window scores.

1. A lexicon of words and stems is learned from labelled rows by log-odds.
2. The trie of the lexicon and the Levenshtein automaton of each term are walked
   together as one automaton over the letters of a word; its states are built
   when first reached and kept. A word dies after a few letters unless it is a
   term, a misspelled term, or goes on from a stem.
3. Around each hit a window tells a quoted or reported term from an abusive one;
   a logistic regression over the hits of a text gives its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

#: Labels are learned from at most so many rows of each class, drawn by a hash of the id.
SAMPLE_TOXIC = 6_000
SAMPLE_CLEAN = 18_000
#: A term must be in so many toxic texts of the sample, with log-odds of so much at least.
MIN_TEXTS = 5
MIN_LOG_ODDS = 3.0
#: Stems have these lengths and stand for at least so many different words.
STEM_LENGTHS = (4, 5, 6)
STEM_WORDS = 3
#: Terms from this length on are also found with one letter changed, added, lost or swapped with its neighbour.
FUZZY_LENGTH = 5
#: Words before and after a hit that are its context.
WINDOW = 8
THRESHOLD = 0.3
#: A worker keeps at most so many words it has judged, and moves between states of the automaton.
CACHE_WORDS = 500_000
CACHE_MOVES = 500_000

WORDS = re.compile(r"\w+|[\"“”«»„]")
QUOTES = frozenset("\"“”«»„")
# fixed values: words that report speech, and words that address a reader
REPORTING = frozenset("said says wrote writes quoted called calls dit écrit sagte schrieb zitiert dijo escribió".split())
ADDRESS = frozenset("you your youre ya tu toi vous votre du dich dir dein ihr euch tú te usted ustedes".split())

FEATURES = ("weight", "exact", "fuzzy", "stems", "terms", "quoted", "reported", "addressed", "crowded", "density")


@dataclass
class Lexicon:
    """Terms with weights; ``stem`` terms match any word that begins with them."""

    terms: list[tuple[str, bool, float]]
    _trie: list[dict] = field(default_factory=list, repr=False)
    _states: dict = field(default_factory=dict, repr=False)
    _moves: dict = field(default_factory=dict, repr=False)
    _ends: list = field(default_factory=list, repr=False)
    _words: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"terms": self.terms}

    def __setstate__(self, state):
        self.__init__(state["terms"])

    def _build(self) -> None:
        self._trie = [{"next": {}, "term": None, "fuzzy": False}]
        for i, (term, stem, _) in enumerate(self.terms):
            at, path = 0, [0]
            for ch in term:
                nxt = self._trie[at]["next"]
                if ch not in nxt:
                    nxt[ch] = len(self._trie)
                    self._trie.append({"next": {}, "term": None, "fuzzy": False})
                at = nxt[ch]
                path.append(at)
            self._trie[at]["term"] = i
            if not stem and len(term) >= FUZZY_LENGTH:
                for node in path:
                    self._trie[node]["fuzzy"] = True
        self._state(frozenset(self._closed({(0, 0, "")})))

    def _closed(self, positions: set) -> set:
        """Positions (node, edits, pending letter) with letters of terms skipped at the cost of an edit."""
        out = set(positions)
        for node, edits, _ in positions:
            if edits == 0:
                for child in self._trie[node]["next"].values():
                    if self._trie[child]["fuzzy"]:
                        out.add((child, 1, ""))
        return out

    def _state(self, positions: frozenset) -> int:
        if positions not in self._states:
            self._states[positions] = len(self._ends)
            best = None
            for node, edits, pending in positions:
                t = self._trie[node]["term"] if not pending else None
                if t is not None and (edits == 0 or len(self.terms[t][0]) >= FUZZY_LENGTH and not self.terms[t][1]):
                    best = min(best or (9, 0), (edits, t))
            stem = next((self._trie[n]["term"] for n, e, p in positions if e == 0 and not p and self._trie[n]["term"] is not None and self.terms[self._trie[n]["term"]][1]), None)
            self._ends.append((positions, best, stem))
        return self._states[positions]

    def _step(self, state: int, ch: str) -> int:
        """Next state, or -1 where no term can be reached any more."""
        out = set()
        for node, edits, pending in self._ends[state][0]:
            nxt = self._trie[node]["next"]
            if pending:  # two letters swapped: the term's first comes second
                if ch == pending[0]:
                    out.add((self._trie[nxt[ch]]["next"][pending[1]], 1, ""))
                continue
            if ch in nxt:
                out.add((nxt[ch], edits, ""))
            if edits == 0 and self._trie[node]["fuzzy"]:
                out.add((node, 1, ""))  # a letter too many
                for first, child in nxt.items():
                    if not self._trie[child]["fuzzy"]:
                        continue
                    if first != ch:
                        out.add((child, 1, ""))  # a letter changed
                        after = self._trie[child]["next"].get(ch)
                        if after is not None and self._trie[after]["fuzzy"]:
                            out.add((node, 1, first + ch))
        return self._state(frozenset(self._closed(out))) if out else -1

    def judge(self, word: str) -> tuple[int, str] | None:
        """(term number, ``exact`` | ``fuzzy`` | ``stem``) of a lower-case word, or None."""
        if word in self._words:
            return self._words[word]
        if len(self._moves) >= CACHE_MOVES:
            self.__init__(self.terms)
        if not self._trie:
            self._build()
        state, stem, out = 0, None, None
        for ch in word:
            key = (state, ch)
            state = self._moves.get(key, -2)
            if state == -2:
                state = self._moves[key] = self._step(key[0], ch)
            if state < 0:
                break
            stem = self._ends[state][2] if stem is None else stem
        if state >= 0 and word and self._ends[state][1]:
            edits, t = self._ends[state][1]
            out = (t, "stem" if self.terms[t][1] else "fuzzy" if edits else "exact")
        if (out is None or out[1] == "fuzzy") and stem is not None:
            out = (stem, "stem")
        if len(word) <= 40:
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            self._words[word] = out
        return out

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[str]]:
        """((word number, term number, kind), ...) and the text's words and quote marks."""
        words = WORDS.findall(text.lower()) if text else []
        known, judge, out = self._words, self.judge, []
        for i, w in enumerate(words):
            h = known[w] if w in known else judge(w)
            if h:
                out.append((i, *h))
        return out, words

    def features(self, text: str | None) -> list[float]:
        """Numbers of FEATURES; zeros if nothing is hit."""
        found, words = self.hits(text)
        if not found:
            return [0.0] * len(FEATURES)
        marks = np.cumsum([w in QUOTES for w in words])
        n = dict.fromkeys(FEATURES, 0.0)
        n["weight"] = sum(self.terms[t][2] for _, t, _ in found)
        n["exact"] = sum(k == "exact" for _, _, k in found)
        n["fuzzy"] = sum(k == "fuzzy" for _, _, k in found)
        n["stems"] = sum(k == "stem" for _, _, k in found)
        n["terms"] = len({t for _, t, _ in found})
        places = np.array([i for i, _, _ in found])
        n["crowded"] = float(max(np.searchsorted(places, places + WINDOW, "right") - np.arange(len(places))))
        n["density"] = 100 * len(found) / len(words)
        for i, _, _ in found:
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            n["quoted"] += bool(marks[i] % 2 and marks[-1] > marks[i])
            n["reported"] += any(w in REPORTING for w in near)
            n["addressed"] += any(w in ADDRESS for w in near)
        return [float(np.log1p(n[k])) for k in FEATURES]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        x = np.array(self.lexicon.features(text))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(toxic, text) of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows that are not held out.

    Rows without a label or an id are not drawn. Of several labels of one id the
    largest counts; documents that repeat an id all come in. Texts stay whole.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity sample")), F.lit(1 << 40))
    drawn = [known.where(cond).select(id_col, "_toxic", share.alias("_share")).orderBy("_share", id_col).limit(n).select(id_col, "_toxic") for cond, n in ((F.col("_toxic") == 1, SAMPLE_TOXIC), (F.col("_toxic") != 1, SAMPLE_CLEAN))]
    ids = drawn[0].unionByName(drawn[1])  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of 12 bytes
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select(F.col("_toxic").cast("int").alias("toxic"), F.col(text_col).alias("text"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems of toxic texts by log-odds against clean ones; ``rows`` is a sample."""
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("word"))
    per_word = words.groupBy("word").agg(F.sum("toxic").alias("c1"), F.count("*").alias("n"))
    n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("c1"), F.count("*").alias("n")).first()
    n1, n0 = n["c1"], n["n"] - n["c1"]
    odds = F.log((F.col("c1") + 0.1) / (n1 + 1.0)) - F.log((F.col("n") - F.col("c1") + 0.1) / (n0 + 1.0))
    good = (F.col("c1") >= MIN_TEXTS) & (F.col("odds") >= MIN_LOG_ODDS)
    exact = per_word.withColumn("odds", odds).where(good).select("word", F.lit(False).alias("stem"), "odds", "c1")
    stems = None
    for k in STEM_LENGTHS:
        part = per_word.where(F.length("word") > k).groupBy(F.substring("word", 1, k).alias("word")).agg(F.sum("c1").alias("c1"), F.sum("n").alias("n"), F.count(F.when(F.col("c1") > 0, 1)).alias("words")).withColumn("odds", odds).where(good & (F.col("words") >= STEM_WORDS)).select("word", F.lit(True).alias("stem"), "odds", "c1")
        stems = part if stems is None else stems.unionByName(part)
    found = exact.unionByName(stems).orderBy(F.desc("c1"), "word", "stem").collect()  # of a bounded sample, each in MIN_TEXTS of its texts
    # a stem that only repeats one word's count adds nothing to it, and must not stand in for that word
    whole = {r["word"]: r["c1"] for r in found if not r["stem"]}
    found = [r for r in found if not r["stem"] or r["c1"] > 1.5 * max((c for w, c in whole.items() if w.startswith(r["word"])), default=0)]
    kept_stems: list[str] = []
    for r in sorted((r for r in found if r["stem"]), key=lambda r: len(r["word"])):
        if not any(r["word"].startswith(s) for s in kept_stems):
            kept_stems.append(r["word"])
    kept = [r for r in found if (r["word"] in kept_stems if r["stem"] else not any(r["word"].startswith(s) for s in kept_stems) or r["c1"] >= 50)]
    return Lexicon([(r["word"], bool(r["stem"]), float(r["odds"])) for r in kept])


def fit(rows: DataFrame, rounds: int = 3000, rate: float = 0.3, ridge: float = 1e-4) -> ToxicityModel:
    """Learn lexicon and regression from a sample (toxic int, text). No rows or one class: a constant score.

    Null and empty texts count as texts without hits, repeated rows as often as they come.
    """
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    data = rows.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    y = np.array([r["toxic"] == 1 for r in data], float)
    n = np.array([r["count"] for r in data], float)
    if not len(y) or y.min() == y.max():
        share = float(y.max()) if len(y) else 0.0
        return ToxicityModel(lexicon, np.zeros(len(FEATURES)), 4.0 if share else -4.0)
    x = np.array([r["x"] for r in data])
    n /= n.sum()
    scale = np.maximum(np.sqrt(n @ x**2), 1e-9)
    w, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        g = n * (1 / (1 + np.exp(-np.clip(x / scale @ w + bias, -30, 30))) - y)
        w -= rate * ((x / scale).T @ g + ridge * w)
        bias -= rate * g.sum()
    return ToxicityModel(lexicon, w / scale, bias)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score double and predicted int; columns of these names are replaced, all rows stay.

    Null and empty texts score as texts without hits. Texts of any length are
    read whole. Ids are not read, so null and repeated ones are harmless. An empty
    table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=schema.names)

    return docs.select(*keep).mapInArrow(run, schema)
