"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, empty tables, very long texts, clashing columns."""

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercadia.llm import collocations as co
from mercadia.llm import negatives as ng
from mercadia.llm import warc

# ---- 11 ----


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_phrases(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    out = set()
    for lang, counts in f.items():
        found = []
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def phrase_rows(seed, n=80):
    r = random.Random(seed)
    words = ["the", "The", "of", "cat", "dög", "naïve", "x", "日本", "a'b", "42", "\x7f", "z-"]
    ends = [" ", " ", "  ", "\t", ". ", ",", "!\n", "\x0b", "; "]
    rows = [(r.choice(("en", "de", None)), "".join(r.choice(words) + r.choice(ends) for _ in range(r.choice((0, 1, 3, 9, 40))))) for _ in range(n)]
    return rows + [("en", None), ("de", ""), (None, "... !"), ("en", rows[3][1]), ("en", rows[3][1]), ("long", "one two three four five six " * 3000)]


@pytest.mark.parametrize(("ranges", "buckets"), [(10**6, 16), (20, 3)])
def test_collocations_equal_brute_force(spark, monkeypatch, ranges, buckets):
    """Also with ranges of a few rows, and with so few buckets that they keep nothing out."""
    monkeypatch.setattr(co, "RANGE", ranges)
    monkeypatch.setattr(co, "BUCKETS", (buckets, buckets))
    monkeypatch.setattr(co, "SLICE", min(buckets, 16))
    monkeypatch.setattr(co, "SAMPLE", 1)
    for seed, least in ((1, 2), (2, 4)):
        rows = phrase_rows(seed)
        df = spark.createDataFrame([(*r, 1, "k", 3) for r in rows], "lang string, text string, n long, phrase string, rank int").repartition(3)
        got = [tuple(r) for r in co.collocations(df, least, 40).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, least, 40)


def test_shards_add_up(spark, monkeypatch):
    """Counts do not hang on how texts are cut into shards and ranges."""
    rows = phrase_rows(5, 200)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    whole = set(map(tuple, co.collocations(df, 3).collect()))
    monkeypatch.setattr(co, "_range_ends", lambda *of: {"en": [(1 << 62,), (1 << 62, 1 << 61), (1 << 63,)], "de": [(7,)]})
    assert set(map(tuple, co.collocations(df.repartition(7), 3).collect())) == whole


def test_packed_automata_are_the_rows():
    r = np.random.default_rng(3)
    for n, v in ((0, 3), (1, 1), (500, 4), (2000, 300)):
        ids, piece = r.integers(1, v + 1, n), np.cumsum(r.random(n) < 0.2)
        rows, counts = co._automaton(ids, piece, v)
        grams = Counter(tuple(int(ids[i + k]) if i + k < n and piece[i + k] == piece[i] else 0 for k in range(co.LONGEST)) for i in range(n))
        assert dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == grams and sorted(map(tuple, rows.tolist())) == list(map(tuple, rows.tolist()))
        hashes = np.sort(r.integers(1, 1 << 63, v).astype(np.uint64))
        back, again, own = co._unpack(co._pack(rows, counts, hashes))
        assert (np.r_[np.uint64(0), own][back] == np.r_[np.uint64(0), hashes][rows]).all() and (again == counts).all()


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(empty).collect() == []
    assert co.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect() == []


def test_ranks_of_a_hot_group(spark):
    rows = [("a", i % 97, i) for i in range(3000)] + [("b", 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = {(r.g, r["rank"]): r.id for r in co.first_by(df.where("g is not null"), "g", [F.desc("v"), F.asc("id")], 50).collect()}
    best = sorted((-v, i) for g, v, i in rows if g == "a")[:50]
    assert got == {("a", k): i for k, (_, i) in enumerate(best, 1)} | {("b", 1): 1}


# ---- 12 ----


def brute_negatives(rows, every=100, n_pos=5, n_neg=5):
    fine = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = Counter()
    for k, (i, lab, v) in enumerate(fine):
        if i % every:
            continue
        scored = sorted((-clamp(sum(a * b for a, b in zip(v, w, strict=False))), j, m) for j, m, w in fine[:k] + fine[k + 1 :])
        for score, p, _ in [s for s in scored if s[2] == lab][:n_pos]:
            fits = [s for s in scored if s[2] != lab and 80 * -score <= 100 * -s[0] <= 100 * -score]
            for rank, (s, j, _) in enumerate(fits[:n_neg], 1):
                out[(i, p, rank, j, -score, -s)] += 1
    return out


def vectors(seed, n=400, dim=6):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, r.choice((0, 1, 2)), [x + r.gauss(0, 0.3) for x in base[i % 5]]) for i in range(n)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(150)]  # equal vectors: ties by vec_id
    bad = [(5000, None, base[0]), (5001, 1, None), (5002, 1, [1.0, None]), (5100, 1, [float("nan")] * dim), (5200, 0, [float("inf")] + base[0][1:]), (None, 1, base[0])]
    return rows + bad + [(5300, 0, []), (5400, 1, base[1][:2]), (5500, 2, [*base[2], 3.0]), (5600, 1, [1e18] * dim), (5700, 2, [1e18] * dim), (5800, 1, [-3e9] * dim)]


def found_negatives(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, b"x") for r in rows], "vec_id long, label int, embedding array<double>, rank int, score long, block binary").repartition(5)
    return Counter(map(tuple, ng.hard_negatives(df, **more).collect()))


@pytest.mark.parametrize(("rows_a_block", "anchors_a_block"), [(2048, 512), (16, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, rows_a_block, anchors_a_block):
    monkeypatch.setattr(ng, "ROWS", rows_a_block)
    monkeypatch.setattr(ng, "ANCHORS", anchors_a_block)
    rows = vectors(1)
    assert found_negatives(spark, rows) == brute_negatives(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = vectors(2, 120)
    rows += [rows[0], rows[0], rows[30], rows[31]]  # an anchor three times, rows twice
    assert found_negatives(spark, rows, every=20) == brute_negatives(rows, 20)
    assert found_negatives(spark, []) == Counter()
    assert found_negatives(spark, [(0, 1, [1.0])]) == Counter()


def test_scores_are_exact_at_any_size():
    for top in (1, 1e3, 1e8, 1e30):
        a = np.floor(np.random.default_rng(4).normal(0, top, (5, 7)))
        exact = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for v in a] for u in a]
        assert ng.scores(a, a).tolist() == exact


# ---- 13 ----

PAGES = "page_id long, url string, html string, payload string, bytes int, row int, digest string"


def pages():
    long = "<html>" + "é" * 200_000
    rows = [(i, f"http://a.example/{i}", ("short", None, "", "x" * 99, "x" * 100, "y" * 100, f"own {i} " * 30, long)[i % 8]) for i in range(60)]
    rows += [(4, "again", "x" * 100), (None, "no id", "x" * 100), (None, None, "z" * 120), (None, None, "z" * 120), (-3, "line\r\nWARC-Type: evil", "y" * 100), (90, "http://b.example/ü", "WARC/1.1\r\n\r\n" * 20)]
    return rows


def test_archives_give_back_all_pages(spark, tmp_path):
    warc.use_warc(spark)
    rows = pages()
    df = spark.createDataFrame([(*r, "p", 1, 2, "d") for r in rows], PAGES).repartition(5)
    warc.archive_pages(df, str(tmp_path / "w"))
    got = warc.read_pages(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows)
    body = lambda h: (h or "").encode()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[body(h)].append(i)
    expected = Counter()
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k and len(payload) >= 100
            expected[(i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    texts = Counter((r.page_id, bytes(r.payload)) for r in got if r.record_type == "response" and r.page_id is not None and r.page_id < 60)
    assert all(n == 1 and p in {body(h) for i, _, h in rows if i == k} for (k, p), n in texts.items())
    urls = {r.page_id: r.target_uri for r in got}
    assert urls[-3] == "line%0D%0AWARC-Type: evil" and urls[90] == "http://b.example/ü"
    everything = spark.read.format("warc").load(str(tmp_path / "w"))
    ids = [r.record_id for r in everything.where("record_type <> 'warcinfo'").select("record_id").collect()]
    refers = [r.refers_to for r in everything.where("record_type = 'revisit'").collect()]
    assert len(set(ids)) == len(ids) == len(rows) and set(refers) <= set(ids)
    members = gzip.open(next((tmp_path / "w").glob("*.warc.gz"))).read()  # any gzip reader can read them
    assert members.startswith(b"WARC/1.1\r\n")


def test_filters_and_payloads_are_pushed_down(spark, tmp_path, monkeypatch):
    warc.use_warc(spark)
    df = spark.createDataFrame([(*r, "p", 1, 2, "d") for r in pages()], PAGES).repartition(2)
    warc.archive_pages(df, str(tmp_path / "w"))
    read = spark.read.format("warc").option("payload", "false").load(str(tmp_path / "w"))
    some = read.where("record_type = 'revisit' and target_uri like 'http://a.example/%' and content_length > 0")
    filters = [x for x in some._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter " in x]
    assert filters and all("content_length" in x and "record_type" not in x and "target_uri" not in x for x in filters)
    assert {r.record_type for r in some.collect()} == {"revisit"} and read.where("payload is not null").count() == 0
    assert read.where("payload_digest is null").count() == read.where("record_type = 'warcinfo'").count()


@pytest.mark.parametrize("packed", [True, False])
def test_records_of_other_writers(packed):
    """Plain and gzip archives, line ends without CR, folded and lower-case fields, blocks without HTTP, skipped payloads."""
    one = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <a>\r\nX-Long: one\r\n two\r\nContent-Length: 12\r\n\r\nWARC/1.0\r\n\r\n\r\n\r\n"
    two = b"WARC/1.1\nWARC-Type: response\nContent-Type: application/http; msgtype=response\nContent-Length: 43\n\nHTTP/1.1 200 OK\nA: 1\nA: 2\nB: x\n\nHello, worl\n\n"
    parts = [one, two, one]
    data = b"".join(map(gzip.compress, parts)) if packed else b"".join(parts)
    got = list(warc.records(io.BytesIO(data)))
    assert [(warc._get(f, "WARC-Type"), p) for f, _, p, _ in got] == [("resource", b"WARC/1.0\r\n\r\n"), ("response", b"Hello, worl"), ("resource", b"WARC/1.0\r\n\r\n")]
    assert got[0][0]["X-Long"] == "one two" and got[1][1]["A"] == "1, 2" and got[1][1][":status"] == "HTTP/1.1 200 OK"
    at = [sum(len(gzip.compress(x) if packed else x) for x in parts[:k]) for k in range(3)]
    assert [o for *_, o in got] == at
    only = list(warc.records(io.BytesIO(data), lambda f: "warc-type" in f, False))
    assert [p for *_, p, _ in only] == [None, None]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(data[:-15] if packed else data[:-8])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(io.BytesIO(b"<html>")))


def test_empty_and_failed_writes(spark, tmp_path):
    warc.use_warc(spark)
    warc.archive_pages(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.read_pages(spark, str(tmp_path / "none")).count() == 0
    bad = spark.createDataFrame([(str(i), "response", "x") for i in range(50)], "record_id string, record_type string, payload string").repartition(2)
    bad = bad.select("record_id", "record_type", F.when(F.col("record_id") == "49", F.raise_error(F.lit("stop"))).otherwise(F.col("payload").cast("binary")).alias("payload"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("warc").mode("append").save(str(tmp_path / "half"))
    assert not [p for p in (tmp_path / "half").glob("*") if not p.name.startswith(".")] if (tmp_path / "half").exists() else True
