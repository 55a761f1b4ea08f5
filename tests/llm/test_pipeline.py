"""Each stage of the pipeline on its own input, against plain Python."""

import collections
import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from chronoslot.llm import pii

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs, out = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert docs.columns == columns
    text = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in inputs.items()}
    assert len(text["line_dedup"]) >= 0.95 * len(text["language_id"])
    # the smallest id of each group of linked texts stays
    rows = sorted(text["ngram_jaccard"].items())
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    ids = list(sets)
    for _ in ids:
        changed = False
        for x, i in enumerate(ids):
            for j in ids[:x]:
                a, b = sets[i], sets[j]
                if a and b and root[i] != root[j] and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
        if not changed:
            break
    assert set(text["pii"]) == {i for i in ids if root[i] == i}
    before, after = text["pii"], text["best_fit_packing"]
    for i, t in before.items():
        assert after[i] == t if not list(pii.find(t)) else after[i] != t
        addresses = set(re.findall(r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[a-z]+", t))
        assert not any(x in after[i] for x in addresses)
    seqs, pieces = collections.defaultdict(list), collections.Counter()
    for r in docs.collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += 1
    assert set(pieces) == set(after)
    for rows in seqs.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 1024


def test_near_copies_leaves_one_work_table(spark):
    """Sets and prefixes have gone before the texts are shuffled: only the ids that stay are read by then."""
    from chronoslot.llm import common

    w = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w, "more"])), (3, "a b c d e f"), (None, "x")], "doc_id long, text string")
    start = set(common.saved)
    out = corpus_pipeline.near_copies(spark, docs, "")
    left = [p for p in common.saved if p not in start]
    assert len(left) == 1 and "/stay-" in left[0]
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 3, None]


def test_clashing_and_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, node long, host string, _text string, _own string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").isEmpty(), name
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog again and again", "en", "s", 5, 1, "h", "t", "o") for i in range(12)]
    docs = spark.createDataFrame([*rows, *rows, (None, "the quick brown fox", "en", None, None, None, None, None, None), (50, None, None, None, None, None, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns[-4:] == ["node", "host", "_text", "_own"], name
    assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id = 50").isEmpty()
