"""The registered queries on the smallest given tables: against their SQL in DuckDB, or against brute force."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from mercadia.llm import queries as llm

DIR, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no given tables")


def documents(folder=DIR, columns=("doc_id", "text", "lang", "source")):
    return sorted(pq.read_table(f"{folder}/documents.parquet", columns=list(columns)).to_pylist(), key=lambda r: r["doc_id"])


def rows(spark, name):
    return {r.doc_id: r for r in llm.queries()[name](spark, DIR).collect()}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod == 2


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(llm.oracle_sql()[name])
    names = sorted(x[0] for x in cur.description)
    at = [[x[0] for x in cur.description].index(n) for n in names]
    expected = sorted(repr([r[i] for i in at]) for r in cur.fetchall())
    df = llm.queries()[name](spark, DIR)
    assert sorted(df.columns) == names
    assert sorted(repr(list(r)) for r in df.select(*names).collect()) == expected


def test_op2(spark):
    found, fps = rows(spark, "op2_simhash_near_dedup"), {}
    for d in documents():
        w = words(lower(d["text"]))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in fps}
    while True:
        now = {i: min(least[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
        if now == least:
            break
        least = now
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {i: (f"{fps[i]:016x}", least[i]) for i in fps}


def test_op3(spark):
    found = rows(spark, "op3_language_id")
    right = []
    for d in documents():
        r = found[d["doc_id"]]
        assert r.held_out == held(d["doc_id"], 4) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d["text"] or ""))
        if r.held_out and d["lang"]:
            right.append(r.lang_pred == d["lang"])
    assert len(found) == len(documents()) and np.mean(right) > 0.95


def test_op5(spark):
    found = rows(spark, "op5_secret_scan")
    key = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    kinds = {"assign": (key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), "access": ("AKIA[A-Z0-9]+", 0, 16), "hex": ("[0-9a-f]+", 0, 32)}
    for d in documents():
        spans = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, (p, g, n)) in enumerate(kinds.items()) for m in re.finditer(p, d["text"] or "") if len(m[g]) >= n]
        r = found[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
        assert {x[2] for x in spans} <= set(r.spans.split(",")) and (r.spans == "") == (not r.spans.split(",")[0])


def test_op8(spark):
    found, docs = rows(spark, "op8_lm_score"), documents()
    tokens = {d["doc_id"]: [*words(lower(d["text"])), ""] for d in docs}
    c = Counter(w for i, t in tokens.items() if not held(i, 7) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 7), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
    out = [r for r in found.values() if r.held_out and r.n_tokens > 1]
    assert all(r.score < 0 for r in out) and np.mean([r.score > r.base_score for r in out]) > 0.6


def test_op10(spark):
    found, docs = rows(spark, "op10_iblt_fingerprints"), documents()[::-1]
    texts = {}
    for k, d in enumerate(docs):
        t, f = d["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        r = found[d["doc_id"]]
        e = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited < 1 or r.fingerprint == r.edited_fingerprint)
        assert texts.setdefault(t, r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in found.values()]) > 0.2 > np.mean([r.near_next for r in found.values()])


def test_near_copies_of_the_pipeline_lose_few_links(spark):
    """Recall over links of unequal texts at a five-word Jaccard similarity of 0.8, and no document joined to an unlike one."""
    from mercadia.llm.simhash import near_copies

    found = {r.doc_id: r.component_id for r in near_copies(spark.read.parquet(f"{MORE}/documents.parquet")).collect()}
    sets, holders = {}, {}
    for d in documents(MORE):
        w = words(lower(d["text"]))
        sets[d["doc_id"]] = s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in s:
            holders.setdefault(g, []).append(d["doc_id"])
    common = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    links = [p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9]
    assert np.mean([found[a] == found[b] for a, b in links if sets[a] != sets[b]]) >= 0.95
    linked = {x for p in links for x in p} | {i for i, s in sets.items() if not s}
    assert all(found[i] == i for i in found if i not in linked)
