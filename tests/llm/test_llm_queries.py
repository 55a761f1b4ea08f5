"""The registered queries without SQL on a whole small table, against plain Python and the libraries themselves."""

import collections
import hashlib
import os
import re
import struct
import zlib

import pytest

pytest.importorskip("chronoslot.llm")
P = pytest.importorskip("public_tokenizers")

from chronoslot.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_url_filter(spark, SF).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    seen = collections.Counter()
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", pages[r["page_id"]] or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(t), t, v) for t, v in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "block" if r["block_score"] >= 0.5 else "allow")
        seen[r["rule"]] += 1
    assert len(seen) > 3


def test_op2(spark, docs):
    """An own detector of addresses and numbers: none of the real ones is left, equal ones stay equal and different ones different."""
    address = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    ip = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])")
    rows = {r["doc_id"]: r for r in queries.op2_pii(spark, SF).collect()}
    assert set(rows) == set(docs)
    found = 0
    for pattern in (address, ip):
        of, back = {}, {}
        for i, d in docs.items():
            before, after = pattern.findall(d["text"] or ""), pattern.findall(rows[i]["text"] or "")
            assert len(before) == len(after)
            for a, b in zip(before, after, strict=True):
                assert of.setdefault(a.lower(), b.lower()) == b.lower() and back.setdefault(b.lower(), a.lower()) == a.lower()
                found += 1
        assert not set(of) & set(back)
    assert found > 10
    for i, d in docs.items():
        if rows[i]["n_entities"] == 0:
            assert rows[i]["text"] == d["text"]


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op3_best_fit_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    lengths = []
    for i, d in docs.items():
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            assert k == 0 or r["length"] == 1024
            at += r["length"]
            lengths.append(r["length"])
        assert at == len(ids)
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    free: list[int] = []  # best-fit decreasing over single pieces
    for n in sorted(lengths, reverse=True):
        best = min((x for x in free if x >= n), default=None)
        if best is None:
            free.append(1024 - n)
        else:
            free[free.index(best)] -= n
    assert len(seqs) <= len(free)


def test_op4(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op4_language_id(spark, SF).collect()}
    assert set(rows) == set(docs)
    known = {d["lang"] for i, d in docs.items() if d["lang"] and not held(i)}
    right = total = 0
    for i, d in docs.items():
        r = rows[i]
        assert r["held_out"] == held(i) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in known | {"und"}
        if held(i) and letters and d["lang"]:
            right, total = right + (r["lang_pred"] == d["lang"]), total + 1
    assert right >= 0.95 * total


def test_op8(spark, docs):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}
    ref = tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in queries.op8_byte_bpe(spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, d in docs.items():
        ids = ref.encode_ordinary(d["text"] or "")
        r = rows[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_op9(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op9_toxicity(spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    clean = [rows[i]["predicted"] for i, t in labels.items() if t == 0 and held(i)]
    assert sum(clean) <= 0.1 * len(clean)
