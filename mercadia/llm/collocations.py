"""Phrase collocations: n-grams counted by weighted acyclic automata, built from sorted shards and united by prefix range."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm.common import discard, materialize, table
from mercadia.llm.tokens import _running, mix, text_chunks

#: Most words of a phrase.
LONGEST = 5
#: Bytes of text in a shard, rows of united automata in a range (as planned), texts in the sample of range ends: one in so many.
SHARD, RANGE, SAMPLE = 16 << 20, 500_000, 8
#: Keys in the sample of range ends, over all tasks.
KEYS = 50_000
#: Logarithms of the least and most buckets of a sketch (32 MB as bits), and of the buckets of a slice.
BUCKETS, SLICE = (16, 28), 16
_SPACE, _BREAK = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_STATE = "kind string, lang string, part int, count long, data binary"
_WORDS = "lang string, hash long, count long, word string, other string"
#: Parts that the words of a shard are dealt to, by the first bits of their hashes.
_PARTS = 64
_PHRASE = "lang string, phrase array<long>, count long"
_SUMS = "slice int, data binary"


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: a number for the hash, 0 for what is no word; whether it ends a piece. A-Z count as a-z."""
    values = np.arange(1, 257, dtype=np.uint64)
    values[65:91] += np.uint64(32)
    breaks = np.zeros(256, bool)
    breaks[list(_BREAK)] = True
    values[list(_SPACE + _BREAK)] = 0
    return values, breaks


_VALUES, _BREAKS = _byte_values()


def _words(texts: list[bytes], spelt: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """Hash of each word, number of its piece, and the spelling of the distinct hashes that spelt wants."""
    hashes, pieces, seen, n = [], [], {}, 0
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= 1 << 20):
            size += len(texts[end]) + 1
            end += 1
        data = b"\n".join(texts[begin:end]) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        v = _VALUES[raw]
        inside = np.r_[False, v != 0]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        run, down = _running(v)
        h = mix((run[ends] - run[starts]) * down[starts])
        broken = np.cumsum(_BREAKS[raw])
        hashes.append(h)
        pieces.append(broken[starts] + n)
        n += int(broken[-1]) + 1
        if spelt is not None:
            wanted = np.flatnonzero(spelt(h))
            new, at = np.unique(h[wanted], return_index=True)
            at = wanted[at]
            for x, s, e in zip(new.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
                if x not in seen:
                    seen[x] = data[s:e].translate(_LOWER)
        begin = end
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(pieces) if pieces else np.zeros(0, np.int64), seen


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _automaton(ids: np.ndarray, piece: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of LONGEST words from each word on, cut at the end of its piece (0 from there on): distinct rows of ids
    (1 to v), sorted, and how often each occurs. Ids are ranked in pairs first, so one number holds a row."""
    n = len(ids)

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        """x from k words on, 0 beyond the piece."""
        out = np.zeros(n, np.uint64)
        if n > k:
            out[: n - k] = np.where(piece[k:] == piece[: n - k], x[k:], 0)
        return out

    first = ids.astype(np.uint64)
    wide = np.uint64(v + 1)
    pairs, rank = np.unique(first * wide + shifted(first, 1), return_inverse=True)
    rank = rank.astype(np.uint64) + np.uint64(1)
    many = np.uint64(len(pairs) + 1)
    if len(pairs) < 1 << 22 and (len(pairs) + 1) ** 2 * (v + 1) < 1 << 64:
        keys = (rank * many + shifted(rank, 2)) * wide + shifted(first, 4)
        keys, counts = np.unique(keys, return_counts=True)
        last, keys = keys % wide, keys // wide
        a, b = keys // many, keys % many
    else:
        fours, four = np.unique(rank * many + shifted(rank, 2), return_inverse=True)
        keys, counts = np.unique(four.astype(np.uint64) * wide + shifted(first, 4), return_counts=True)
        last, four = keys % wide, fours[(keys // wide).astype(np.int64)]
        a, b = four // many, four % many
    pairs = np.r_[np.uint64(0), pairs]
    a, b = pairs[a.astype(np.int64)], pairs[b.astype(np.int64)]
    return np.stack((a // wide, a % wide, b // wide, b % wide, last), 1).astype(np.uint32), counts


def _pack(rows: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> bytes:
    """An automaton as bytes: the hashes of its words, and for each row the length that it shares with the row before,
    its length, its other words and its count; each kind together, as they pack better so."""
    used, inverse = np.unique(rows[rows > 0], return_inverse=True)
    small = np.zeros(rows.shape, np.uint32)
    small[rows > 0] = inverse + 1
    shared = np.r_[0, np.cumprod(small[1:] == small[:-1], 1, np.uint8).sum(1)] if len(small) else np.zeros(0, np.int64)
    lengths = (small > 0).sum(1)
    place = np.arange(LONGEST)
    own = small[(place >= shared[:, None]) & (place < lengths[:, None])]
    head = np.array([len(used), len(rows), len(own)], np.int64)
    parts = (head, hashes[used.astype(np.int64) - 1], (np.minimum(shared, lengths) * 8 + lengths).astype(np.uint8))
    wide = own.astype("<u4").view(np.uint8).reshape(-1, 4)
    counts = counts.astype("<u8").view(np.uint8).reshape(-1, 8)
    body = b"".join(x.tobytes() for x in parts) + wide.T.tobytes() + counts.T.tobytes()
    return zlib.compress(body, 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ids, counts and hashes of what _pack packed."""
    data = zlib.decompress(data)
    v, n, own = np.frombuffer(data, np.int64, 3).tolist()
    at = 24
    hashes = np.frombuffer(data, np.uint64, v, at)
    at += 8 * v
    marks = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    words = np.frombuffer(data, np.uint8, 4 * own, at).reshape(4, own).T.copy().view("<u4").ravel()
    at += 4 * own
    counts = np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T.copy().view("<u8").ravel().astype(np.int64)
    shared, lengths = marks // 8, marks % 8
    rows = np.zeros((n, LONGEST), np.uint32)
    place = np.arange(LONGEST)
    rows[(place >= shared[:, None]) & (place < lengths[:, None])] = words
    for d in range(LONGEST):  # what is shared is that of the last row that has its own
        mine = np.maximum.accumulate(np.where(shared <= d, np.arange(n), 0))
        rows[:, d] = np.where(d < lengths, rows[mine, d], 0)
    return rows, counts, hashes


def _by_lang(langs: list[str], texts: list[bytes]) -> dict[str, list[bytes]]:
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts, strict=True):
        by.setdefault(lang, []).append(text)
    return by


# ---- sketches: which words and pairs can be frequent ----


@dataclass(frozen=True)
class Sketch:
    """A bit for each bucket of keys: whether the keys of the bucket occur often enough together. What occurs often enough
    by itself is always in; some of the rest is, too, and is only counted in vain."""

    bits: np.ndarray
    log: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.log)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _word_keys(lang: str, h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")))


def _pair_keys(keys: np.ndarray) -> np.ndarray:
    """Of each key and the one after it."""
    return mix(keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + keys[1:])


def _often(lang: str, h: np.ndarray, piece: np.ndarray, words: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of neighbours in a piece whose words can both be frequent, and where the pairs begin."""
    keys = _word_keys(lang, h)
    fine = words.has(keys)
    at = np.flatnonzero(fine[1:] & fine[:-1] & (piece[1:] == piece[:-1]))
    return (_pair_keys(keys)[at] if len(at) else np.zeros(0, np.uint64)), at


def _count_keys(log: int, words: Sketch | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums by bucket of the keys of all words, or of pairs of words that can be frequent, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _chunked(batches, SHARD):
            found = []
            for lang, own in _by_lang(langs, texts).items():
                h, piece, _ = _words(own)
                found.append(_word_keys(lang, h) if words is None else _often(lang, h, piece, words)[0])
            at, n = np.unique(np.concatenate(found) >> np.uint64(64 - log), return_counts=True)
            part = (at >> np.uint64(SLICE)).astype(np.int64)
            slices = np.unique(part)
            edges = np.r_[np.searchsorted(part, slices), len(part)]
            data = [zlib.compress((at[i:j] & np.uint64((1 << SLICE) - 1)).astype("<u2").tobytes() + n[i:j].astype("<u4").tobytes(), 1) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(data, pa.binary())], ["slice", "data"])

    return run


def _add_slices(least: int) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The buckets of a slice that come to least or more, as bits."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLICE, np.int64)
        for batch in batches:
            for data in batch.column("data"):
                raw = zlib.decompress(data.as_py())
                n = len(raw) // 6
                total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["slice", "data"])

    return run


def _sketch(texts: DataFrame, log: int, least: int, words: Sketch | None = None) -> Sketch:
    """Counts of all texts by bucket; the bits of frequent buckets come to the driver, 32 MB at most."""
    sums = texts.mapInArrow(_count_keys(log, words), _SUMS).groupBy("slice").applyInArrow(_add_slices(least), _SUMS)
    bits = np.zeros(1 << (log - 3), np.uint8)
    for r in sums.collect():
        bits[r.slice << (SLICE - 3) : (r.slice + 1) << (SLICE - 3)] = np.frombuffer(r.data, np.uint8)
    return Sketch(bits, log)


# ---- automata ----


def _runs(lang: str, texts: list[bytes], words: Sketch, pairs: Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, bytes], np.ndarray, int]:
    """Hashes and run numbers of the words in runs of pairs that can be frequent; hashes, spelling and counts of the words
    that can be; the number of all words."""
    h, piece, seen = _words(texts, lambda h: words.has(_word_keys(lang, h)))
    keys, at = _often(lang, h, piece, words)
    linked = np.zeros(len(h) + 1, bool)
    linked[at[pairs.has(keys)] + 1] = True  # to the word before
    inside = np.flatnonzero(linked[1:] | linked[:-1])
    run = np.cumsum(~linked[:-1])[inside]
    known, counts = np.unique(h[words.has(_word_keys(lang, h))], return_counts=True)
    return h[inside], run, known, seen, counts, len(h)


def _shards(langs: list[str], texts: list[bytes], words: Sketch, pairs: Sketch) -> Iterator[tuple]:
    """Language, rows, counts, hashes; hashes, spelling and counts of words; number of words, for each language's texts."""
    for lang, own in _by_lang(langs, texts).items():
        h, run, known, seen, counts, n = _runs(lang, own, words, pairs)
        hashes = np.unique(h)
        rows, times = _automaton(np.searchsorted(hashes, h) + 1, run, len(hashes)) if len(h) else (np.zeros((0, LONGEST), np.uint32), np.zeros(0, np.int64))
        phrases = rows[:, 1] > 0  # a last word alone is no phrase
        yield lang, rows[phrases], times[phrases], hashes, known, seen, counts, n


def _chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts by about size bytes of text, over batches; a longer text is never cut."""
    langs, texts, total = [], [], 0
    for batch in batches:
        names = batch.column("lang").to_pylist()
        for begin, end, part in text_chunks(batch.column("text")):
            if texts and total + sum(map(len, part)) > size:
                yield langs, texts
                langs, texts, total = [], [], 0
            langs, texts, total = langs + names[begin:end], texts + part, total + sum(map(len, part))
    if texts:
        yield langs, texts


def _sample(keys: int, words: Sketch, pairs: Sketch) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Some rows of each task's automata, as hashes, with the number of rows each stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _chunked(batches, SHARD):
            parts = list(_shards(langs, texts, words, pairs))
            step = max(1, sum(len(p[1]) for p in parts) // keys)
            for lang, rows, _, hashes, *_ in parts:
                at = np.arange(step // 2, len(rows), step)
                full = np.r_[np.uint64(0), hashes][rows[at]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(list(full.view(np.int64)), pa.list_(pa.int64())), pa.array(np.full(len(at), step))], ["lang", "phrase", "count"])

    return run


def _cut(rows: np.ndarray, hashes: np.ndarray, ends: list[tuple[int, ...]]) -> np.ndarray:
    """Where sorted rows pass each range end: by binary search, as their hashes are in order too."""
    full = np.r_[np.uint64(0), hashes]
    out = []
    for end in ends:
        low, high = 0, len(rows)
        while low < high:
            middle = (low + high) // 2
            if tuple(full[rows[middle]].tolist()) < end:
                low = middle + 1
            else:
                high = middle
        out.append(low)
    return np.array(out, np.int64)


def _build(ends: dict[str, list[tuple[int, ...]]], words: Sketch, pairs: Sketch) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards' automata, cut at the range ends of their language, and their words with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _chunked(batches, SHARD):
            for lang, rows, counts, hashes, known, seen, times, n in _shards(langs, texts, words, pairs):
                cuts = np.r_[0, _cut(rows, hashes, ends.get(lang, [])), len(rows)]
                for k in range(len(cuts) - 1):
                    if cuts[k] < cuts[k + 1]:
                        part = slice(cuts[k], cuts[k + 1])
                        yield _row("automaton", lang, k, None, _pack(rows[part], counts[part], hashes))
                yield _row("total", lang, None, n, None)
                place = (known >> np.uint64(64 - _PARTS.bit_length() + 1)).astype(np.int64)
                for k in np.unique(place).tolist():
                    part = slice(*np.searchsorted(place, (k, k + 1)))
                    spelt = b"\n".join(seen[x] for x in known[part].tolist())  # no word holds a line end
                    yield _row("word", lang, k, None, zlib.compress(known[part].tobytes() + times[part].astype("<i8").tobytes() + spelt, 1), len(known[part]))

    return run


def _row(kind: str, lang: str, part: int | None, count: int | None, data: bytes | None, words: int | None = None) -> pa.RecordBatch:
    """A row of _STATE; count is the number of words for rows of words."""
    values = zip((kind, lang, part, count if words is None else words, data), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], ["kind", "lang", "part", "count", "data"])


def _unite_words(least: int) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of a language's part with their summed counts, if these come to least; other is a second spelling of the
    same hash."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for n, data in zip(batch.column("count").to_pylist(), batch.column("data"), strict=True):
                raw = zlib.decompress(data.as_py())
                for h, times, word in zip(np.frombuffer(raw, np.int64, n).tolist(), np.frombuffer(raw, "<i8", n, 8 * n).tolist(), raw[16 * n :].split(b"\n"), strict=True):
                    held = found.setdefault(h, [0, word, None])
                    held[0] += times
                    if held[1] != word:
                        held[2] = word
        rows = [(h, *x) for h, x in found.items() if x[0] >= least]
        text = lambda k: pa.array([None if r[k] is None else r[k].decode("utf-8", "replace") for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), text(2), text(3)], ["lang", "hash", "count", "word", "other"])

    return run


def _unite(least: int) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The union of the automata of a language's range, weights summed. Each prefix of a row is a phrase; its count is the
    sum of the rows below. Out go those of least or more, and those on the first and last path, which other ranges may
    share."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room = 2 * RANGE
        for batch in batches:
            for data in batch.column("data"):
                ids, n, h = _unpack(data.as_py())
                held.append((np.r_[np.uint64(0), h][ids], n))
                if sum(len(x[1]) for x in held) > room:
                    held = [_sum(held)]
                    room = max(room, 2 * len(held[0][1]))
        rows, counts = _sum(held)
        lengths = (rows > 0).sum(1)
        for d in range(2, LONGEST + 1):  # words alone are counted apart
            deep = np.flatnonzero(lengths >= d)  # prefixes stand together, as rows are sorted
            if not len(deep):
                break
            part = rows[deep, :d]
            new = np.r_[True, (part[1:] != part[:-1]).any(1)]
            starts = np.flatnonzero(new)
            total = np.add.reduceat(counts[deep], starts)
            keep = total >= least
            keep[0] = keep[-1] = True
            found = part[starts[keep]].view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, d), pa.int32()), pa.array(np.ascontiguousarray(found).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(found), pa.string()), flat, pa.array(total[keep])], ["lang", "phrase", "count"])

    return run


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashes of all parts, sorted, each once, with summed counts."""
    rows, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    parts.clear()
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
    return rows[starts], np.add.reduceat(counts, starts)


def _range_ends(texts: DataFrame, words: Sketch, pairs: Sketch) -> dict[str, list[tuple[int, ...]]]:
    """By language, the ends between ranges of about RANGE rows each, from a sample of about KEYS rows of all tasks. They
    steer only where rows meet; beyond KEYS ranges, ranges grow instead."""
    tasks = max(1, texts.rdd.getNumPartitions())
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    by: dict[str, list[tuple[tuple[int, ...], int]]] = {}
    for r in some.mapInArrow(_sample(min(512, max(1, KEYS // tasks)), words, pairs), _PHRASE).collect():
        by.setdefault(r.lang, []).append((tuple(x % (1 << 64) for x in r.phrase), r["count"] * SAMPLE))
    out = {}
    for lang, keys in by.items():
        ends, total = [], 0
        for key, n in sorted(keys):
            if total >= RANGE and (not ends or key > ends[-1]):
                ends.append(key)
                total = 0
            total += n
        out[lang] = ends
    return out


def phrase_counts(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, count) of all phrases of up to LONGEST words, as hashes, that occur least times or more; (lang, hash,
    count, word) of such words; and (lang, n), all words of a language. Raises if two words of a language have the same
    64-bit hash and could be in a phrase."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log = min(max(int(size // 8).bit_length(), BUCKETS[0]), BUCKETS[1])
    often = _sketch(texts, log, least)
    pairs = _sketch(texts, log, least, often)
    built = materialize(texts.mapInArrow(_build(_range_ends(texts, often, pairs), often, pairs), _STATE))
    words = materialize(built.where("kind = 'word'").select("lang", "part", "count", "data").groupBy("lang", "part").applyInArrow(_unite_words(least), _WORDS))
    if words.where("other is not null").limit(1).count():
        raise ValueError("two words share a hash")
    totals = materialize(built.where("kind = 'total'").groupBy("lang").agg(F.sum("count").alias("n")))
    united = built.where("kind = 'automaton'").select("lang", "part", "data").groupBy("lang", "part").applyInArrow(_unite(least), _PHRASE)
    phrases = united.groupBy("lang", "phrase").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    phrases = materialize(phrases.unionByName(words.select("lang", F.array("hash").alias("phrase"), "count")))
    discard(built)
    return phrases, words.drop("other"), totals


def first_by(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group with their rank, by a range sort over all groups: a group of any size is dealt out,
    and counts by range give the rank of a range's first row."""
    ordered = rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    ordered = materialize(ordered)
    counts = ordered.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n).drop("_n")
    within = Window.partitionBy(group, "_range").orderBy(*order)
    ranked = ordered.join(starts, [group, "_range"]).withColumn("rank", F.row_number().over(within) + F.col("_before"))
    return ranked.where(F.col("rank") <= n).drop("_range", "_before")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """The strongest phrases of two to five words of each language.

    docs: lang, text. Returns lang, rank, phrase, a, l, r, n, score. A-Z are lower-cased; pieces end at . , ; : ! ? and
    line ends, words at blanks and tabs. n counts the words of the language, a the phrase; cut after any word, it gives
    l and r, the counts of its parts, and floor(1000 * a * n / (l * r)); the least of these counts, ties to the first
    cut. Phrases of least occurrences are ranked unless a longer one contains them and is as frequent: it is enough to
    look at phrases of one word more, since counts never rise as phrases grow.

    Two passes over the texts first sum up words, then pairs of words, by bucket; n-grams are made only of pairs whose
    bucket is frequent, which loses no frequent phrase, however full the buckets are. Each task sorts the n-grams of its
    shard and makes an automaton of them: rows share the prefix of the row before, the count of a phrase is the sum of the
    rows below. Automata are cut at range ends, which a sample sets, so no prefix is too hot for a task; a range's automata
    are united and weights summed. The counts of parts are looked up by joins on the counted phrases: parts of what is
    frequent are frequent.

    Nulls: a null text has no words, a null lang is ``und``. Texts of any length are read whole; repeated rows count each
    for itself; ties go by a, then by phrase in the order of its UTF-8 bytes. An empty table gives an empty result; extra
    columns are ignored.
    """
    phrases, words, totals = phrase_counts(docs, least)
    found = phrases.withColumn("size", F.size("phrase"))
    cuts = found.where("size > 1").select("lang", "phrase", "size", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda of, n: phrases.select("lang", F.col("phrase").alias(of), F.col("count").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.expr("cast(1000 as decimal(38,0)) * a0 * n0 div (l0 * r0)")
    cuts = cuts.withColumns({f"{c}0": whole(c) for c in "anlr"}).withColumn("score", score).drop("a0", "n0", "l0", "r0")
    cuts = materialize(cuts)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = lambda c: cuts.where("size > 2").where(F.col("k") == (F.col("size") - 1 if c == "left" else 1)).where("a = l" if c == "left" else "a = r").select("lang", F.col(c).alias("phrase"))
    best = best.join(inner("left").unionByName(inner("right")).distinct(), ["lang", "phrase"], "left_anti")
    best = best.select("lang", "phrase", "a", "n", "best.*").drop("k")
    # a phrase's words by its hashes: each word of a phrase is a row, put together again in its place
    spelt = best.select("lang", "phrase", F.posexplode("phrase").alias("at", "hash")).join(words.select("lang", "hash", "word"), ["lang", "hash"])
    spelt = spelt.groupBy("lang", "phrase").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    best = best.join(spelt, ["lang", "phrase"]).withColumn("phrase", F.concat_ws(" ", "words.word")).drop("words")
    ranked = first_by(best, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of documents, of 100 occurrences or more. Edge cases as in collocations."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counted AS MATERIALIZED (
  SELECT lang, list_slice(w, i, i + k - 1) AS p, count(*) AS f
  FROM split, range(1, len(w) + 1) t(i), range(1, 6) u(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING k = 1 OR count(*) >= 100),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE len(p) = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, n,
         (1000 * CAST(c.f AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
  FROM (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM counted WHERE len(p) > 1 AND f >= 100) c
  JOIN counted l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, k)
  JOIN counted r ON r.lang = c.lang AND r.p = list_slice(c.p, k + 1, len(c.p))
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (
  SELECT DISTINCT lang, list_slice(p, i, i + m - 1) AS p, a AS f
  FROM best, range(1, 6) t(i), range(2, 5) u(m) WHERE m < len(p) AND i + m - 1 <= len(p)),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.p = b.p AND 100 * i.f >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
