"""Operators against brute force on small tables, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "zo") for b in ("n", "ra", "si", "tu", "vel", "x", "yo", "é")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp long, spans string, component_id long, range int, part int, words string"


def docs(spark, rows):
    """(doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, s, None, 7, 0.5, 1, "x", 9, 3, 2, "w") for i, t, l, s in rows], DOCS)


def corpus(n=60, seed=1):
    r = random.Random(seed)
    shared = " ".join(r.choice(WORDS) for _ in range(40))
    rows = []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.choice((0, 1, 2, 5, 12, 13, 14, 40, 120)))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = shared.split()[i % 7 : 30 + i % 9]
        rows.append((i, " ".join(w), ("aa", "bb")[i % 2], ("s1", "s2", None)[i % 3]))
    rows += [(n + 1, None, None, None), (n + 2, rows[5][1], "aa", "s1"), (n + 3, "!!! ... 123", "aa", "s1"), (n + 4, shared + " " + shared, "bb", "s2"), (None, shared, "bb", "s2")]
    return rows


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


# ---- 2 ----


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_fingerprints_and_groups(spark):
    from mercadia.llm.simhash import near_duplicates

    rows = [r for r in corpus() if r[0] is not None]
    r = random.Random(3)
    for i in range(20):  # near copies of a long text
        w = corpus()[3][1].split() * 6
        w[r.randrange(len(w))] = "zzz"
        rows.append((200 + i, " ".join(w), "aa", "s1"))
    rows.append(rows[0])
    found = near_duplicates(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in found} == fps
    ids = sorted(fps)
    expected = closure(ids, [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3])
    assert {r.doc_id: r.component_id for r in found} == expected
    assert near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [2, 1000])
def test_crowded_buckets_lose_no_link(spark, crowd):
    from mercadia.llm.components import components
    from mercadia.llm.simhash import links

    r = random.Random(5)
    fps = set()
    for _ in range(4):
        center = r.getrandbits(64)
        for _ in range(60):
            fps.add(center ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    table = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in links(table, 3, crowd).collect()}
    true = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert found <= true if crowd == 1000 else closure(range(len(fps)), found) == closure(range(len(fps)), true)
    joined = {r.node: r.component for r in components(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
    expected = closure(range(len(fps)), true)
    assert all(joined.get(i, i) == expected[i] for i in range(len(fps)))


def test_thresholds_cover_the_radius():
    from mercadia.llm.simhash import allocate

    for m in (2, 3, 4):
        _, t = allocate([[0, 10.0 + i, 20.0 + i] for i in range(m)], [[0, 1.0, 9.0]] * m, 3)
        assert sum(x + 1 for x in t) == 4


def test_components_of_a_long_chain_and_a_star(spark):
    from mercadia.llm.components import components

    edges = [(i, i + 1) for i in range(70)] + [(1000, i) for i in range(900, 960)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(71)} | {i: 900 for i in [*range(900, 960), 1000]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_at_a_similarity(spark):
    from mercadia.llm.simhash import near_copies

    r = random.Random(8)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(400)]
    rows = [(1, " ".join(base), "aa", "s"), (2, " ".join(base), "aa", "s")]
    for i in range(3, 9):
        w = list(base)
        w[40 * i] = "changed"
        rows.append((i, " ".join(w), "aa", "s"))
    half = base[:200] + [r.choice(WORDS) + "q" for _ in range(200)]
    rows += [(20, " ".join(half), "aa", "s"), (21, None, None, None), (22, "", None, None), (None, " ".join(base), "aa", "s")]
    found = {x.doc_id: x.component_id for x in near_copies(docs(spark, rows)).collect() if x.doc_id is not None}
    assert found == {**{i: 1 for i in range(1, 9)}, 20: 20, 21: 21, 22: 21}


def near_pairs(n, low, high, seed, words=200):
    """n pairs of texts with a five-word Jaccard similarity of low to high."""
    r, out = random.Random(seed), []
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(out) < n:
        a = [r.choice(WORDS) + str(r.randrange(99)) for _ in range(words)]
        b = list(a)
        for _ in range(r.randrange(2, 9)):
            b[r.randrange(words)] = "w" + str(r.randrange(9999))
        x, y = grams(a), grams(b)
        if low <= len(x & y) / len(x | y) < high:
            out.append((" ".join(a), " ".join(b)))
    return out


def test_near_copies_are_found_near_the_limit(spark):
    from mercadia.llm.simhash import near_copies

    pairs = near_pairs(150, 0.8, 0.84, 1) + near_pairs(150, 0.84, 0.9, 2) + near_pairs(100, 0.7, 0.79, 3)
    rows = [(2 * i + k, t, "aa", "s") for i, p in enumerate(pairs) for k, t in enumerate(p)]
    found = {x.doc_id: x.component_id for x in near_copies(docs(spark, rows)).collect()}
    assert [i for i in range(300) if found[2 * i + 1] != 2 * i] == []
    assert all(found[i] == i for i in range(600, 800))


@pytest.mark.parametrize("turns", [0, 1, 4])
def test_near_copies_that_differ_from_their_leader_are_compared(spark, turns):
    from mercadia.llm.simhash import near_copies

    r = random.Random(31)
    lines = [" ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(6)) for _ in range(40)]
    other = lines[:]
    r.shuffle(other)
    base, rows = " ".join(lines), [(1, " ".join(other), "aa", "s")]  # 1: the words of 2, in another order
    rows += [(2, base, "aa", "s"), (3, base + " end", "aa", "s")]
    # a large bucket of two unlike halves: each is joined, neither to the other, and pairs that no leader joins are tried
    for g in range(2):
        own = [r.choice(WORDS) + "q" + str(r.randrange(99)) for _ in range(300)]
        for k in range(12):
            w = list(own)
            w[20 * k + 5] = w[20 * k + 12] = w[20 * k + 19] = "changed"
            rows.append((100 + 50 * g + k, " ".join(w), "aa", "s"))
        if g:
            half = own[:150] + rows[-13][1].split()[:150]
            rows.append((200, " ".join(half), "aa", "s"))
    found = {x.doc_id: x.component_id for x in near_copies(docs(spark, rows), turns=turns).collect()}
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = {i: grams(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert found == closure(sorted(sets), links)
    assert found[1] == 1 and found[3] == 2


# ---- 3 ----


def test_sample_of_repeated_rows_and_crossing_texts(spark):
    """2,000 equal rows of one language are learned like one; a language of one short and one long text is learned in full."""
    from mercadia.llm.langid import training_sample

    rows = [(None, "alpha beta gamma", "xx", None)] * 2000 + [(k, f"delta {k}", "yy", None) for k in range(20)]
    got = training_sample(docs(spark, rows).repartition(4), 8, 24_000, 10)
    assert got["xx"] == "alpha beta gamma\n" and len(got["yy"].splitlines()) == 8
    both = [(k, t, f"l{k // 2:02}", None) for k, t in enumerate(x for n in range(20) for x in (f"short {n}", f"{n:02} " * 7998 + "x"))]
    got = training_sample(docs(spark, both).repartition(4), 64, 24_000, 30)
    assert {len(t.replace("\n", "")) for t in got.values()} == {24_000}
    many = training_sample(docs(spark, [(k, f"text {k} " * 10, "en", None) for k in range(500)]), 64, 1_000, 3)
    assert 1_000 <= len(many["en"]) <= 1_064


def test_language_by_cross_parsing(spark):
    from mercadia.llm.langid import Parser, held_out, identify, letters, suffix_automaton

    r = random.Random(2)
    a, b = "the and of this with from", "que los para con una sobre"
    rows = [(i, " ".join(r.choice((a, b)[i % 2].split()) for _ in range(30)), ("en", "es")[i % 2], "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "123 !!", "en", "s"), (102, "", None, "s")]
    table = docs(spark, rows)
    found = by_id(identify(table, table), "lang_pred", "score")
    assert all(found[i][0] == ("en", "es")[i % 2] for i in range(60))
    assert found[100] == found[101] == found[102] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in found.values())
    assert {x[0] for x in by_id(identify(table, table.limit(0)), "lang_pred").values()} == {"und"}
    assert identify(table.limit(0), table).count() == 0
    got = {r.doc_id: r.h for r in table.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    # ties go to the first by code point; languages without a common script, and only long texts, are learned
    han = [(200 + i, "".join(chr(0x4E00 + 3000 * (i % 2) + r.randrange(3000)) for _ in range(900)), ("zh", "ja")[i % 2], "s") for i in range(40)]
    more = docs(spark, [*han, (300, "same words here", "b", "s"), (301, "same words here", "a", "s"), (302, "long " * 20_000, "l", "s")])
    found = by_id(identify(more, more), "lang_pred", "score")
    assert all(found[200 + i][0] == ("zh", "ja")[i % 2] for i in range(40))
    assert found[300] == found[301] == ("a", 0.0) and found[302][0] == "l"
    with pytest.raises(ValueError, match="languages"):
        identify(more, more, max_langs=3)

    # phrases against a plain parse; over block ends, with rare and unknown letters, tables or none
    def plain(sample, text):
        sample, text = (re.sub(r"[\W\d_]+", " ", t.lower()) for t in (sample, text))
        assert "".join(map(chr, letters(text))) == text
        count, i = 0, 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in sample:
                j += 1
            i, count = j, count + 1
        return count

    alphabet = "ab\u00e9\u0416 cdefgh" + "".join(chr(0x4E00 + i) for i in range(90))
    long = "".join(r.choice(alphabet) for _ in range(300)) * 12
    samples = {"x": "abracadabra abba", "y": "".join(r.choice(alphabet) for _ in range(2000)), "z": long[7:900]}
    texts = ["abraba cabbadab zzab", "", "q", long, "".join(r.choice(alphabet + "\u03b1") for _ in range(3000)), "ab" * 700, samples["y"][100:1800]]
    for table_bytes in (64 << 20, 0):
        p = Parser(samples, table_bytes)
        expected = [[plain(samples[k], t) * a.bits for k, a in zip(p.langs, p.automata)] for t in texts]
        assert p.bits_of(texts) == pytest.approx(np.array(expected))
    states = suffix_automaton([2, 3, 2, 4])
    assert states[0][2] > 0 and 5 not in states[0]


# ---- 4 ----


def test_mix_meets_targets(spark):
    from mercadia.llm.mixing import mix

    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(30)), None, ("a", "b", "c", "d", None)[min(4, int(r.random() ** 2 * 5))]) for i in range(800)]
    rows += [(1000, None, None, "a"), (1001, "x y", None, "zz"), (1001, "x y", None, "zz")]
    found = mix(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    size, taken, target, longest = Counter(), Counter(), {}, Counter()
    for x in found:
        assert x.taken in (0, x.size, 2 * x.size)
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        longest[x.source] = max(longest[x.source], x.size)
    total = sum(size.values())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, full = {}, set()
    while True:  # share, cap, share the rest again
        left = 1.5 * total - sum(2 * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        want = {s: 2 * size[s] if s in full else left * weight[s] / w for s in names}
        more = {s for s in names if want[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= longest[s] + 1 for s in names)
    assert sum(taken.values()) <= 1.5 * total
    assert sorted(map(str, mix(docs(spark, rows).repartition(7)).collect())) == sorted(map(str, found))
    assert mix(docs(spark, [])).count() == 0


# ---- 5 ----


def test_secret_spans_and_ownership(spark):
    from mercadia.llm.secrets import KINDS, op5_secret_scan, secrets  # noqa: F401

    hexes = "0123456789abcdef" * 2 + "00"
    rows = [
        (1, f'é token = "{hexes}" end', None, "a"), (2, "PASSWORD:short", None, "a"), (3, "token=api_key: abcdefgh12", None, "b"), (4, "xAKIAABCDEFGHIJKL123 AKIA12", None, "b"),
        (5, None, None, None), (6, "", None, "c"), (7, "key Zx9Qw8Er7Ty6Ui5Op4As3Df alone", None, "c"), (9, f"{hexes}", None, "b"), (10, f"secret={hexes}", None, "c"), (10, f"secret={hexes}", None, "c"),
        (11, "ſecret = abcdefghij", None, "a"), (12, "apikey='Abcdefgh_1' api_key : \"12345678\"", None, "a"),
    ]

    def brute(text):
        out = []
        for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
            if len(m[2]) >= 8:
                out.append((m.start(), 0, m.end()))
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
        return sorted(out)

    found = secrets(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for x in found:
        assert [(s.start, s.kind, s.end) for s in x.spans if s.kind < 3] == brute(texts[x.doc_id])
    spans = {x.doc_id: x.spans for x in found}
    assert {s.verdict for s in spans[9]} == {"example"}  # held by owners a, b and c
    assert [s.kind for s in spans[7]] == [3] and spans[7][0].verdict == "live"
    assert secrets(docs(spark, [])).count() == 0


# ---- 7 ----


def brute_repeats(rows, n=13):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def test_substring_dedup(spark):
    from mercadia.llm.substrings import repeats

    rows = corpus(90)
    long = " ".join(random.Random(9).choice(WORDS) for _ in range(30_000))
    rows += [(300, long, "aa", "s"), (299, "start " + long[5000:90_000] + " end", "aa", "s"), (301, long[:400] + " " + long[400:], "bb", "s")]
    table = docs(spark, rows).repartition(5)
    found = by_id(repeats(table).withColumn("sha", F.sha2("kept", 256)), "n_words", "n_removed", "sha")
    assert found == brute_repeats(rows)
    # hot anchors, and passages that a task has sent before, change nothing
    for more in ({"hot_runs": 0, "every": 1}, {"chunk_bytes": 300}, {"hot_runs": 3, "every": 2, "chunk_bytes": 2000, "bucket_bytes": 1000}):
        assert by_id(repeats(table, **more).withColumn("sha", F.sha2("kept", 256)), "n_words", "n_removed", "sha") == found
    same = [(1, "a " * 20, None, None), (1, "a " * 20, None, None), (1, "b " * 15, None, None), (2, "b " * 14, None, None)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeats(docs(spark, same)).collect())
    assert got == [(1, 15, 0), (1, 20, 0), (1, 20, 0), (2, 14, 14)]
    copies = [(i, " ".join(WORDS[:20]), None, None) for i in range(9, 0, -1)]
    got = {r.doc_id: r.n_removed for r in repeats(docs(spark, copies).coalesce(1), chunk_bytes=700).collect()}
    assert got == {i: 20 * (i > 1) for i in range(1, 10)}
    assert repeats(docs(spark, [])).count() == 0


# ---- 9 ----


def test_decontamination_both_ways(spark):
    from mercadia.llm.decontaminate import contamination

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = corpus(50)
    shared = rows[-2][1].split()
    items = [("i1", " ".join(shared[2:20])), ("i2", " ".join(shared[8:18]).upper()), ("i3", "kan lora"), ("i4", None), ("i5", "!!"), (None, "kan"), ("i6", "mix"), ("i7", " ".join(shared[:9]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")

    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    expected = {}
    for i, t, *_ in rows:
        w, hit, names = word.findall(lower(t)), set(), set()
        for name, u in items:
            v = word.findall(lower(u))
            if name is None or not v:
                continue
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(name)
        expected[i] = (len(w), sorted(hit), sorted(names))
    for limit in (64 << 20, 0):
        found = contamination(docs(spark, rows), benchmark, broadcast_bytes=limit).collect()
        got = {x.doc_id: (x.n_words, sorted(k for h in x.hits for k in range(h.start, h.end)), sorted(x["items"])) for x in found if x.doc_id is not None}
        assert got == {k: v for k, v in expected.items() if k is not None}
        assert len(found) == len(rows)
    assert contamination(docs(spark, []), benchmark).count() == 0
    assert all(not x.hits for x in contamination(docs(spark, rows), benchmark.limit(0)).collect())


def test_decontamination_same_by_join_with_null_and_repeated_ids(spark):
    from mercadia.llm.decontaminate import contamination

    rows = corpus(30)
    shared = rows[-2][1].split()
    rows += [(8, "same " * 3000, "aa", "s1"), (None, "clean words only", "aa", "s1"), (None, "start " + " ".join(shared[3:25]) + " kan", "aa", "s1"), (5, " ".join(shared[1:16]), "aa", "s1"), (5, "nothing here", "aa", None), (6, None, None, None), (7, shared[4], None, None)]
    benchmark = spark.createDataFrame([("i1", " ".join(shared[2:20])), ("i2", " ".join(shared[8:22])), ("i3", "kan"), (None, "lora"), ("i4", "same " * 2000), ("i1", " ".join(shared[:12]))], "item_id string, text string")
    for keep in (("doc_id",), ("doc_id", "text", "lang", "source", "n_chars"), ("source",)):
        got = []
        for limit in (64 << 20, 0):
            found = contamination(docs(spark, rows).repartition(3), benchmark, broadcast_bytes=limit, keep=keep)
            assert found.columns == [*keep, "n_words", "hits", "items"]
            got.append(sorted(str((*(x[c] for c in keep), x.n_words, x.hits, sorted(x["items"]))) for x in found.collect()))
        assert len(got[0]) == len(rows) and got[0] == got[1]



def test_decontamination_by_join_where_many_items_share_a_window_met_often(spark):
    from mercadia.llm.decontaminate import contamination, item_classes, runs_of

    shared = " ".join(f"s{k}" for k in range(12))
    items = [(f"i{k:03}", f"{shared} own{k} tail{k}") for k in range(150)] + [("short", "s3 s4"), ("other", " ".join(f"o{k}" for k in range(10)))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = [(k, f"w{k} {shared} " * 40, "aa", "s1") for k in range(60)] + [(60, shared + " own7 tail7", "aa", "s1"), (61, " ".join(f"o{k}" for k in range(10)), "aa", "s1"), (62, "s3 s4", None, None), (63, None, None, None)]
    got = [sorted(str((x.doc_id, x.n_words, x.hits, sorted(x["items"]))) for x in contamination(docs(spark, rows), benchmark, broadcast_bytes=limit).collect()) for limit in (64 << 20, 0)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    windows = spark.createDataFrame([(i, 10, h, h) for h in range(3) for i in ("a", "b")] + [("a", 10, 7, 7), ("b", 10, 8, 8), ("b", 2, 0, 0)], "item_id string, n long, hash long, check long")
    classes = item_classes(windows).collect()
    assert len(classes) == 6 and len({(r.k, r.x, r.y) for r in classes}) == 3
    places = spark.createDataFrame([(1, 0, 3), (1, 0, 2), (1, 3, 2), (1, 9, 2), (1, 10, 1), (1, 12, 1), (2, 5, 10), (2, 6, 2), (2, 14, 3)], "_row long, start long, n long")
    assert {r[0]: [tuple(h) for h in r[1]] for r in runs_of(places).collect()} == {1: [(0, 5), (9, 11), (12, 13)], 2: [(5, 17)]}


# ---- 10 ----


def test_iblt_round_trip():
    from mercadia.llm.iblt import build, difference, encoded, likeness, peel, pieces

    r = np.random.default_rng(1)
    texts = [b"", b"one two three four five", b"one two three four six"] + [b"\n".join(b" ".join(b"w%d" % x for x in r.integers(0, 9000, 7)) for _ in range(n)) for n in (3, 40, 400)]
    texts.append(texts[-1].replace(b"w1", b"w2", 5))
    p = pieces(texts, 4)
    sets = [set(p[0][a:b].tolist()) for a, b in zip(p[1][:-1], p[1][1:])]
    pairs = [(a, b) for a in range(len(texts)) for b in range(len(texts))]
    a, b = (np.array(x) for x in zip(*pairs))
    owner, found, sign, tries = difference(p, a, p, b)
    held = np.diff(p[1])
    near = likeness(held[a] + held[b], owner)
    for k, ((x, y), v) in enumerate(zip(pairs, near)):
        both = len(sets[x] | sets[y])
        assert v == pytest.approx(len(sets[x] & sets[y]) / both if both else 1.0)
        assert set(found[(owner == k) & (sign == 1)].tolist()) == sets[x] - sets[y]
        assert set(found[(owner == k) & (sign == -1)].tolist()) == sets[y] - sets[x]
    assert tries.max() > 1
    keys = np.array([3, 5, 9], np.uint64)
    owner, found, sign, done = peel(*build(keys, np.zeros(3, int), np.array([1, -1, 1]), np.array([8])), np.array([8]))
    assert dict(zip(found.tolist(), sign.tolist())) == {3: 1, 5: -1, 9: 1} and done[0] and not owner.any()
    whole = pieces([b"one two three four five\n\nsix", b"one two three four five", b"six"], None)
    assert np.diff(whole[1]).tolist() == [2, 1, 1] and set(whole[0][:2].tolist()) == set(whole[0][2:].tolist())
    names = encoded(p, len(texts))
    assert len(set(names)) == len(texts) and encoded(pieces([texts[3]], 4), 1)[0] == names[3]


@pytest.mark.parametrize("per_range", [300, 1 << 20])
def test_successive_documents(spark, per_range):
    from mercadia.llm.iblt import compare_successive, edited, pieces

    rows = [r for r in corpus(40, 7) if r[0] is not None] + [(5000, "x" * 3, None, None), (-7, "ééé \U0001f600 ü", None, None)]
    found = by_id(compare_successive(docs(spark, rows).repartition(6), 4, per_range), "n_chars", "edited_sha256", "near_edited", "near_next", "lost", "added")
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, *_) in enumerate(order):
        t, f = t or "", order[(k + 1) % len(order)][1] or ""
        assert found[i][:2] == (len(t), hashlib.sha256(edited(t, f).encode()).hexdigest())
        a, b, c = (set(pieces([x.encode()], 4)[0].view(np.int64).tolist()) for x in (t, edited(t, f), f))
        assert found[i][2:4] == pytest.approx([len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)])
        assert set(found[i][4]) == a - b and set(found[i][5]) == b - a
    again = compare_successive(docs(spark, [*rows, (None, "n", None, None), (None, None, None, None), rows[3], rows[3]]), 4, per_range)
    assert again.count() == len(rows) + 4
    assert compare_successive(docs(spark, [])).count() == 0
    one = compare_successive(docs(spark, [(1, "a b", None, None)])).collect()
    assert one[0].near_next == 1.0


# ---- 1 and 6 ----


def test_licenses_by_header_file_and_directory(spark):
    from mercadia.llm.licenses import scan

    files = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/x.py", "import os\nprint(1)"), (3, "r/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "r/a/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."), (5, "r/a/b/z.py", None), (6, "q/w.py", "the license of the poet"), (7, None, ""), (8, "r/v.py", "text"),
    ]
    table = spark.createDataFrame([(*f, "x", 1.0) for f in files], "file_id long, path string, text string, license string, score double")
    found = {r.file_id: (r.license, r.origin, r.from_dir) for r in scan(table).collect()}
    assert found == {
        1: ("MIT", "file", None), 2: ("GPL-3.0", "inherited", "r/a"), 3: ("Apache-2.0", "header", None), 4: ("GPL-3.0", "file", None),
        5: ("GPL-3.0", "inherited", "r/a"), 6: (None, "none", None), 7: (None, "none", None), 8: ("MIT", "inherited", "r"),
    }
    assert scan(table.limit(0)).count() == 0


def test_url_rules_and_redirects(spark):
    from mercadia.llm.urls import judge, match_rules

    pages = [
        (1, "http://bad.com/x", '<a href="http://nope.net/">'), (2, "https://mirror.org/x?utm_source=a#f", '<link href="http://bad.com/x" rel="canonical">'), (3, "http://next.org/", '<META http-equiv="refresh" content="0; url=https://mirror.org/x">'),
        (4, "http://good.org/ok", '<link rel=canonical href=http://bad.com/x>'), (5, "http://Sub.BAD.com/y?q=1", None), (6, None, "<p>"), (7, "nothing", None), (8, "ftp://free.org", '<link rel="canonical" href="/x">'), (1, "http://bad.com/x", None),
    ]
    table = spark.createDataFrame([(*p, "v", "h") for p in pages], "page_id long, url string, html string, verdict string, host string")
    rules = spark.createDataFrame([("bad.com", "/", "block")], "host string, path string, verdict string")
    found = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(table, rules).drop("component").na.fill("-").collect())
    assert [(i, v) for i, _, _, _, v in found] == [(1, "block"), (1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "block"), (6, "allow"), (7, "allow"), (8, "allow")]
    assert found[5][1:4] == ("sub.bad.com", "/y", "bad.com/") and found[6][1:4] == ("", "", "-") and found[8][1:3] == ("free.org", "")
    allowed = rules.union(spark.createDataFrame([("good.org", "", "allow")], "host string, path string, verdict string"))
    again = {r.page_id: r.verdict for r in judge(table, allowed).collect()}
    assert again[2] == again[3] == "allow" and again[4] == "allow" and again[1] == "block"
    urls = table.select("page_id", F.lower(F.regexp_extract("url", "//([^/?#]*)", 1)).alias("host"), F.regexp_extract("url", "//[^/?#]*([^?#]*)", 1).alias("path"))
    many = spark.createDataFrame([("com", "/", "allow"), ("bad.com", "/y", "block"), ("org", "", "block"), ("good.org", "/o", "allow")], "host string, path string, verdict string")
    few, joined = (sorted(map(str, match_rules(urls, many, n).collect())) for n in (256, 0))
    assert few == joined
    assert judge(table.limit(0), rules).count() == 0


def test_hot_anchors_are_found_in_small_tasks(spark):
    """An anchor that all texts hold is hot however the texts are dealt out, also where each task has a few of them."""
    from mercadia.llm.substrings import hot_anchors

    r = random.Random(5)
    shared = " ".join(r.choice(WORDS) for _ in range(20))
    rows = [(k, f"{' '.join(r.choice(WORDS) + str(r.random()) for _ in range(15))} {shared} {' '.join(r.choice(WORDS) + str(r.random()) for _ in range(15))}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {n: hot_anchors(df.repartition(n), 13, 5, 2 << 20, 500, 16).tolist() for n in (1, 8)}
    assert found[1] == found[8] and found[1]
    assert hot_anchors(df.repartition(8), 13, 5, 2 << 20, 10_000, 16).tolist() == []


# ---- 8 ----


def test_gru_gradient_and_probabilities():
    from mercadia.llm.gru import Gru

    g = Gru(10, embed=4, hidden=5, per_class=4)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    g.dead = g.dead.astype(np.float64)
    r = np.random.default_rng(0)
    x, y, h = r.integers(0, 10, (4, 3)), r.integers(0, 10, (4, 3)), r.standard_normal((3, 5)) * 0.1
    _, grads, _ = g.gradient(x, y, h)
    for k in g.p:
        for at in [tuple(r.integers(0, s) for s in g.p[k].shape) for _ in range(4)]:
            was, eps, losses = g.p[k][at], 1e-3, []
            for d in (eps, -eps):
                g.p[k][at] = was + d
                losses.append(g.gradient(x, y, h)[0])
            g.p[k][at] = was
            assert grads[k][at] == pytest.approx((losses[0] - losses[1]) / (2 * eps), abs=2e-4)
    state = r.standard_normal((1, 5)).astype(np.float32)
    total = sum(np.exp(g.log_probs(state, np.array([w]))[0][0]) for w in range(10))
    assert total == pytest.approx(1, abs=1e-5)
    text = [r.integers(0, 10, n).astype(np.int16) for n in (1, 7, 150, 64, 65)]
    assert g.score(text, window=64) == pytest.approx(g.score(text, window=1000, lanes=2), abs=1e-3)


def test_language_model_scores(spark):
    from mercadia.llm.gru import score

    r = random.Random(6)
    rows = [(i, " ".join(("red blue", "one two three")[i % 2].split()[k % (2 + i % 2)] for k in range(40)), None, None) for i in range(60)] + [(100, None, None, None), (101, "", None, None), (102, "Unseen RED words", None, None)]
    r.shuffle(rows)
    table = docs(spark, rows)
    train = table.where("doc_id < 50")
    counts = Counter(w for i, t, *_ in rows if i < 50 for w in [*t.lower().split(), ""])
    n, v = sum(counts.values()), len(counts)
    for frequent in (200_000, 2):
        found = {x.doc_id: x for x in score(table, train, shortlist=6, frequent=frequent, rates=(0.02,) * 4).collect()}
        for i, t, *_ in rows:
            w = [*(t or "").lower().split(), ""]
            assert found[i].base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w))
            assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        if frequent > 2:
            assert np.mean([found[i].score > found[i].base_score for i in range(50, 60)]) > 0.8
    assert score(table.limit(0), train).count() == 0
    assert score(table, table.limit(0)).count() == len(rows)



def test_language_model_is_the_same_however_rows_are_dealt(spark):
    """Also with repeated rows, a null doc_id and a very long text: equal texts have equal scores."""
    from mercadia.llm.gru import score

    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(30)), None, None) for i in range(40)]
    rows += [(3, "again and again", None, None)] * 25 + [(None, "again and again", None, None)] * 25 + [(None, "w1 " * 60_000, "aa", "s1"), (None, None, None, None)]
    got = []
    for n in (1, 7):
        table = docs(spark, rows).repartition(n)
        spark.conf.set("spark.sql.files.minPartitionNum", n)
        got.append(sorted((str(x.doc_id), x.n_tokens, x.score) for x in score(table, table, shortlist=12, rates=(0.02, 0.01)).collect()))
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert [x[:2] for x in got[0]] == [x[:2] for x in got[1]] and len(got[0]) == len(rows)
    assert [x[2] for x in got[0]] == pytest.approx([x[2] for x in got[1]], rel=1e-4)
    again = [x[2] for x in got[0] if x[1] == 4]
    assert len(again) == 50 and again == pytest.approx([again[0]] * 50, rel=1e-5)


def test_language_model_learns_from_every_text(spark, monkeypatch):
    """No sample of the training texts: all go to train, and its rounds learn from each copy of each once."""
    from mercadia.llm import gru

    def count(batches, model, rate, kind, lanes):
        n = np.zeros(203)
        for batch in batches:
            for ids, copies in zip(batch.column("ids").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                n += copies * np.bincount(np.frombuffer(ids, kind), minlength=203)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, 203)), pa.array([n.sum(), *n])], ["k", "value"])

    given = []
    monkeypatch.setattr(gru, "train", lambda model, texts, *_: given.append(texts.count()))
    rows = [(i, f"w{i} {'a b c ' * (i % 3)}", None, None) for i in range(3000)] + [(5000, None, None, None)]
    gru.score(docs(spark, rows), docs(spark, rows)).count()
    assert given == [3001]
    monkeypatch.undo()
    texts = docs(spark, rows[:200] + [(7, "again", None, None)] * 30).select(F.xxhash64("doc_id", "text").alias("at"), "text")
    monkeypatch.setattr(gru, "_learn", count)
    for least, times in ((1, 1), (1 << 40, 4)):
        rounds = []
        monkeypatch.setattr(gru.Gru, "take", lambda _, values, rounds=rounds: rounds.append(values))
        gru.train(gru.Gru(203), texts, {b"w%d" % i: i + 2 for i in range(200)} | {b"again": 202}, (0.1,) * 4, least_tokens=least)
        met = [np.flatnonzero(x[2:202]) for x in rounds]
        assert sorted(np.concatenate(met).tolist()) == sorted([*range(200)] * times)
        if times > 1:
            assert all(x[202] == pytest.approx(30 * x[2]) for x in rounds)


def test_gru_learns_from_every_word_of_a_piece():
    from mercadia.llm.gru import Adam, Gru

    for size in (2, 5, 800, 24 * 32 * 3 + 17):
        g, seen = Gru(10, embed=4, hidden=5, per_class=4), []
        inner = g.gradient
        g.gradient = lambda x, y, h: (seen.extend(y.ravel().tolist()), inner(x, y, h))[1]
        ids = np.random.default_rng(size).integers(0, 10, size)
        g.fit(ids, Adam())
        assert sorted(seen) == sorted(ids[1:].tolist())


def test_language_model_takes_words_and_windows_at_once():
    """Words of many texts as the contract splits them; a long text's windows get wider as others end."""
    from mercadia.llm.gru import Gru, tokens_of

    r = random.Random(8)
    texts = ["".join(r.choice("aZ É\x1c\x1f\x0b\x0c\t\n\r \x85\xa0İ") for _ in range(r.randrange(30))) for _ in range(500)] + [None, "", " "]
    for column in (pa.array(texts), pa.array(texts).slice(3, 400)):
        found, first = tokens_of(column)
        found = [w.encode() for w in found.to_pylist()]
        assert [found[a:b] for a, b in zip(first, first[1:], strict=False)] == [(t or "").encode().lower().split() for t in column.to_pylist()]
    many = pa.array(["Some words of a text " * 200] * 5000)
    for low in (0, 2000, 2500, 4000):
        found, first = tokens_of(many.slice(low, 1000))
        assert len(found) == first[-1] == 1000 * 1000
    g, made = Gru(10, embed=4, hidden=5, per_class=4), []
    inner = g.steps
    g.steps = lambda x, *a, **k: (made.append(x.size), inner(x, *a, **k))[1]
    long = [np.arange(n) % 10 for n in (20_000, 3, 700, 0)]
    whole = g.score(long)
    assert len(made) < 20 and max(made) <= 16 * 512
    assert whole == pytest.approx(g.score(long, window=50, lanes=1), rel=1e-5)


# ---- the pipeline ----


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(11)
    en, es = "the and of this with from have that".split(), "que los para con una sobre desde esta".split()
    rows = []
    for i in range(80):
        w = [r.choice((en, es)[i % 2]) + r.choice(("", "", str(r.randrange(400)))) for _ in range(120)]
        rows.append((i, " ".join(w), ("en", "es")[i % 2], f"s{i % 4}", 0))
    passage = " ".join(f"item{k}" for k in range(15))
    rows += [(100, rows[3][1], "es", "s1", 0), (101, rows[4][1].replace("the", "thx", 1), "en", "s1", 0), (102, rows[6][1][:300] + " " + passage, "en", "s2", 0)]
    rows += [(103, rows[8][1][:200] + " token = \"q8Zk3LmN0pR5tV7x\" " + rows[10][1][:300], "en", "s3", 0), (104, "12345 !!!", "en", "s0", 0), (105, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
        if k < len(p.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept[0] == {*range(80), 100, 101, 102, 103}
    assert kept[1] == {*range(80), 102, 103}
    assert kept[2] == kept[3] == {*range(80), 103}
    text = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 103").first().text
    assert "[secret]" in text and "q8Zk3LmN0pR5tV7x" not in text
    assert kept[4] <= kept[3] and len(kept[4]) > 40
    assert {x.doc_id for x in p.run(spark, str(tmp_path)).collect()} == kept[4]


def test_pipeline_links_by_simhash(spark):
    """Each pair that operator 2 links is one group, also below the similarity of 0.8; so are copies of its texts."""
    import corpus_pipeline as p
    from mercadia.llm.simhash import near_copies, near_duplicates

    r = random.Random(21)
    rows = []
    for i in range(40):
        w = [r.choice(WORDS) + str(r.randrange(99)) for _ in range(300)]
        line = " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(7)) + " "
        rows += [(10 * i + k, line * 60 + " ".join(w[150 * k : 150 * k + 150])) for k in (0, 1)]
        rows += [(10 * i + 2, rows[-1][1]), (10 * i + 3, " ".join(w))]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    by_bits = {x.doc_id: x.component_id for x in near_duplicates(table).collect()}
    by_share = {x.doc_id: x.component_id for x in near_copies(table).collect()}
    joined = closure(sorted(by_bits), [*by_bits.items(), *by_share.items()])
    assert sum(joined[i] != by_share[i] for i in joined) > 20
    kept = {x.doc_id for x in p.near_duplicates(spark, table, "").collect()}
    assert kept == set(joined.values())


def test_pipeline_rows_without_own_id(spark):
    import corpus_pipeline as p

    r = random.Random(12)
    text = [" ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(60)) for _ in range(6)]
    secret = [f'token = "q8Zk3LmN0pR5tV7{c}" ' for c in "xyz"]
    rows = [(None, text[0]), (None, text[0]), (None, text[1]), (7, text[1]), (8, text[2]), (8, text[3]), (None, "short"), (None, text[4]), (9, text[5]), (9, text[5] + " end")]
    table = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(((x.doc_id, x.text) for x in p.near_duplicates(spark, table, "").collect()), key=str)
    assert [x for x in kept if x[0] != 9] == sorted([(None, text[0]), (7, text[1]), (8, text[2]), (8, text[3]), (None, "short"), (None, text[4])], key=str)
    assert sum(x[0] == 9 for x in kept) == 1
    rows = [(None, "long text before " + secret[0] + "after"), (None, "clean text that is long enough to be cut at the offsets of another"), (None, "short"), (8, secret[1] + "a"), (8, "aa " + secret[2]), (8, "clean")]
    table = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], table.schema).repartition(3)
    masked = {x.source: x.text for x in p.mask_secrets(spark, table, "").collect()}
    assert len(masked) == 6 and all(masked[f"s{k}"] == rows[k][1] for k in (1, 2, 5))
    assert [masked[f"s{k}"] for k in (0, 3, 4)] == ['long text before [secret]" after', '[secret]" a', 'aa [secret]" ']


def test_pipeline_holds_few_documents_at_a_time(spark):
    """Its stages read Arrow batches of bounded rows; a batch's texts are unpacked piece by piece."""
    import tracemalloc

    import corpus_pipeline as p
    from mercadia.llm.simhash import fingerprints

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    table = spark.range(5000).selectExpr("id as doc_id", "concat('the words of ', id) as text", "'en' as lang", "'s' as source", "1L as n_chars").coalesce(1)
    for stage in (p.language, p.near_duplicates, p.mask_secrets):
        spark.conf.unset(key)
        assert stage(spark, table.limit(3), "").count() <= 3
        sizes = table.mapInArrow(lambda b: (pa.RecordBatch.from_pydict({"n": [x.num_rows]}) for x in b), "n long").collect()
        assert len(sizes) > 1 and max(r.n for r in sizes) <= 1000
    spark.conf.unset(key)

    class Table:
        def select(self, *_):
            return self

        def mapInArrow(self, scan, _):
            self.scan = scan
            return self

    texts = [f"{i} " + ("x" * 9_999 + " ") * 100 for i in range(60)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(62)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    found = [x for b in fingerprints(Table()).scan(iter([batch])) for x in b.column("fp").to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 62 and found[60:] == [0, 0] and most < 20 << 20
