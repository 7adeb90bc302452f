"""Document fingerprints as invertible Bloom lookup tables of paragraph pieces (operator 10)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, table
from mercadia.llm.tokens import byte_values, mix, words

_VALUES = byte_values(lower=False, alnum=False)
CELLS = 12  # of a fingerprint; three subtables
_SALT = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def pieces(texts: list[bytes], size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of the texts' paragraphs, and where each text's begin. A paragraph is a line that has words. With
    a size its words are cut into pieces of so many from its start on, so that a change leaves the other pieces alone."""
    w = words(texts, _VALUES)
    doc = w.doc
    if not len(doc):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(b"\n".join(texts), np.uint8) == 10), w.start)
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    nth = np.arange(len(line)) - np.repeat(begin, np.diff(np.r_[begin, len(line)]))
    place = nth % size if size else nth
    head = np.flatnonzero(place == 0)
    digest = mix(np.add.reduceat(mix(w.hash + place.astype(np.uint64) * _SALT[0]), head))
    owner = doc[head]
    order = np.lexsort((digest, owner))
    digest, owner = digest[order], owner[order]
    new = np.r_[True, (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])]
    digest, owner = digest[new], owner[new]
    return digest, np.searchsorted(owner, np.arange(len(texts) + 1))


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ _SALT[3])


def _cells(keys: np.ndarray, base: np.ndarray, sub: np.ndarray, j: int) -> np.ndarray:
    """A key's cell in subtable j of its table."""
    return base + j * sub + (mix(keys ^ _SALT[j]) % sub.astype(np.uint64)).astype(np.int64)


def build(keys: np.ndarray, owner: np.ndarray, sign: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tables of 3 * sub cells each: counts, sums of keys and of their checks. A negative sign subtracts."""
    base = np.cumsum(np.r_[0, 3 * sub])
    count, total, check = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.uint64)
    signed = sign.astype(np.uint64)
    for j in range(3):
        at = _cells(keys, base[owner], sub[owner], j)
        np.add.at(count, at, sign)
        np.add.at(total, at, keys * signed)
        np.add.at(check, at, _check(keys) * signed)
    return count, total, check, base


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, base: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The table, digest and sign of each one recovered, and whether a table's were all recovered. Cells that hold one
    digest give it up, again and again."""
    found: list[tuple[np.ndarray, ...]] = []
    of = np.repeat(np.arange(len(sub)), 3 * sub)
    while True:
        one = np.flatnonzero(np.abs(count) == 1)
        sign = count[one].astype(np.uint64)
        keys = total[one] * sign  # -1 modulo 2**64 is its own inverse
        pure = _check(keys) * sign == check[one]
        if not pure.any():
            break
        owner, keys, sign = of[one][pure], keys[pure], count[one][pure]
        order = np.lexsort((keys, owner))
        new = np.r_[True, (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
        owner, keys, sign = owner[order][new], keys[order][new], sign[order][new]
        found.append((owner, keys, sign))
        signed = sign.astype(np.uint64)
        for j in range(3):
            at = _cells(keys, base[owner], sub[owner], j)
            np.subtract.at(count, at, sign)
            np.subtract.at(total, at, keys * signed)
            np.subtract.at(check, at, _check(keys) * signed)
    left = (count != 0) | (total != 0) | (check != 0)
    kinds = (np.int64, np.uint64, np.int64)
    return *(np.concatenate([np.zeros(0, k), *(x[i] for x in found)]) for i, k in enumerate(kinds)), np.bincount(of, left, minlength=len(sub)) == 0


def _ranges(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the digests of some texts, and to which of them each belongs."""
    sizes = first[which + 1] - first[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[which], sizes), owner


def difference(a: tuple[np.ndarray, np.ndarray], ia: np.ndarray, b: tuple[np.ndarray, np.ndarray], ib: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pair, digest and sign (1: only in a, -1: only in b) of all that texts ia of a and ib of b differ in, recovered by
    peeling, in the order of pairs; and the tries of each pair.

    The first try subtracts tables of the fingerprints' size, each further one tables four times as large."""
    tries = np.zeros(len(ia), np.int64)
    todo, sub, out = np.arange(len(ia)), CELLS // 3, []
    while len(todo):
        at_a, owner_a = _ranges(a[1], ia[todo])
        at_b, owner_b = _ranges(b[1], ib[todo])
        keys = np.r_[a[0][at_a], b[0][at_b]]
        sign = np.r_[np.ones(len(at_a), np.int64), -np.ones(len(at_b), np.int64)]
        subs = np.full(len(todo), sub)
        owner, keys, sign, done = peel(*build(keys, np.r_[owner_a, owner_b], sign, subs), subs)
        tries[todo] += 1
        good = done[owner]
        out.append((todo[owner[good]], keys[good], sign[good]))
        todo, sub = todo[~done], sub * 4 + 1  # another size also deals the cells anew
    owner, keys, sign = (np.concatenate([np.zeros(0, k), *(x[i] for x in out)]) for i, k in enumerate((np.int64, np.uint64, np.int64)))
    order = np.argsort(owner, kind="stable")
    return owner[order], keys[order], sign[order], tries


def likeness(size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Share of common pieces of pairs with ``size`` pieces on both sides together, of which those of owner differ; 1 without any."""
    differ = np.bincount(owner, minlength=len(size))
    return np.where(size > 0, (size - differ) / np.maximum(size + differ, 1), 1.0)


def encoded(p: tuple[np.ndarray, np.ndarray], n: int) -> list[bytes]:
    """Fingerprints: number of pieces, then each cell's count, sum and check."""
    sub = np.full(n, CELLS // 3)
    count, total, check, _ = build(p[0], np.repeat(np.arange(n), np.diff(p[1])), np.ones(len(p[0]), np.int64), sub)
    out = np.zeros(n, np.dtype([("n", "<u4"), ("count", "<u2", CELLS), ("total", "<u8", CELLS), ("check", "<u4", CELLS)]))
    out["n"], out["count"] = np.diff(p[1]), count.reshape(n, CELLS)
    out["total"], out["check"] = total.reshape(n, CELLS), check.reshape(n, CELLS)
    raw = out.tobytes()
    return [raw[i * out.itemsize : (i + 1) * out.itemsize] for i in range(n)]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, tries int, "
    "n_lost long, n_added long, lost array<long>, added array<long>"
)
#: What a range hands out: its results, then its first and its last row, whose neighbours are in other ranges.
_SCHEMA = f"{_RESULT}, at int, edge string, text string"


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _digests(owner: np.ndarray, keys: np.ndarray, n: int, wanted: bool) -> pa.Array:
    if not wanted:
        return pa.nulls(n, pa.list_(pa.int64()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(keys.view(np.int64)))


def _compare(ids: list, texts: list[str], following: list[str], size: int | None, digests: bool) -> pa.RecordBatch:
    """A row for each text with the one that follows it."""
    n = len(texts)
    other = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    own, new, after = (pieces(x, size) for x in ([t.encode() for t in texts], other, [t.encode() for t in following]))
    i = np.arange(n)
    held = [np.diff(x[1]) for x in (own, new, after)]
    owner, keys, sign, tries = difference(own, i, new, i)
    owner_next, _, _, more = difference(own, i, after, i)
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in other]),
        pa.array(encoded(own, n)), pa.array(encoded(new, n)), pa.array(likeness(held[0] + held[1], owner)), pa.array(likeness(held[0] + held[2], owner_next)),
        pa.array(np.maximum(tries, more).astype(np.int32)), *(pa.array(np.bincount(owner[sign == s], minlength=n)) for s in (1, -1)),
        *(_digests(owner[sign == s], keys[sign == s], n, digests) for s in (1, -1)),
        pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCHEMA.split(", ")])


def _stream(batches: Iterator[pa.RecordBatch], size: int | None, digests: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one range come in order; a megabyte of them is compared at a time."""
    at, ids, texts, total, first = TaskContext.get().partitionId(), [], [], 0, None
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def edge(which: str, i: int | None, text: str) -> pa.RecordBatch:
        row = {"doc_id": i, "at": at, "edge": which, "text": text}
        kinds = [pa.int64(), pa.int64(), *(pa.binary(),) * 3, *(pa.float64(),) * 2, pa.int32(), *(pa.int64(),) * 2, *(pa.list_(pa.int64()),) * 2, pa.int32(), *(pa.string(),) * 2]
        return pa.RecordBatch.from_arrays([pa.array([row.get(c)], k) for c, k in zip(names, kinds, strict=True)], names)

    for batch in batches:
        for i, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
            if first is None:
                first = (i, t or "")
            ids.append(i)
            texts.append(t or "")
            total += len(texts[-1])
            if len(texts) > 1 and total > 1 << 20:
                yield _compare(ids[:-1], texts[:-1], texts[1:], size, digests)
                ids, texts, total = ids[-1:], texts[-1:], len(texts[-1])
    if first is not None:
        if len(texts) > 1:
            yield _compare(ids[:-1], texts[:-1], texts[1:], size, digests)
        yield edge("first", *first)
        yield edge("last", ids[-1], texts[-1])


def _edges(batches: Iterator[pa.RecordBatch], size: int | None, digests: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
            yield _compare([i], [t], [f], size, digests)


def compare_successive(docs: DataFrame, piece_words: int | None = None, range_bytes: int = 64 << 20, digests: bool = True) -> DataFrame:
    """Fingerprint each text, the text edited with the next one's beginning, and their likeness.

    docs: doc_id, text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, tries, n_lost, n_added, lost, added. The next document is the one with the next smaller doc_id; the first follows the
    last. Texts are range-sorted once, about range_bytes a range, and compared as they stream by; the first and last
    rows of ranges are joined to each other. A fingerprint is a table of cells that hold counts and sums of paragraph
    digests (of pieces of piece_words words, if given); subtracting two tables cancels common ones and peeling recovers
    the others: lost are those that only the text has, added those that only the edited text has (null without
    digests; n_lost and n_added count them). Where peeling fails,
    larger tables are tried until it succeeds. Likeness is the share of distinct digests that both texts have; 1 for two
    texts without words.

    Null texts are empty. Null doc_ids come after all others; rows of equal doc_id follow in the order of a hash of the
    text, so that any number of them are spread over ranges. A single row is its own next. An empty table gives an
    empty result. Texts of any length are whole. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(math.ceil(size / range_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").desc_nulls_last(), "_hash", "_row"]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = materialize(ranged.mapInArrow(lambda b: _stream(b, piece_words, digests), _SCHEMA))
    edges = found.where("edge is not null").select("doc_id", "at", "edge", "text")
    # a row a range: each last row meets the first row of the range after it, the last one that of the first
    following = Window.orderBy("at")
    heads = edges.where("edge = 'first'").select("at", F.col("text").alias("following"))
    after = heads.select("at", F.coalesce(F.lead("at").over(following), F.first("at").over(following)).alias("next"))
    pairs = edges.where("edge = 'last'").join(after, "at").select("doc_id", "text", F.col("next").alias("at")).join(heads, "at")
    names = [c.split()[0] for c in _RESULT.split(", ")]
    rest = pairs.select("doc_id", "text", "following").mapInArrow(lambda b: _edges(b, piece_words, digests), _SCHEMA)
    every = found.where("edge is null").select(*names).unionByName(rest.select(*names))
    as_text = {c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}  # written as they are, they take less room
    return every.withColumns({"edited_sha256": F.lower(F.hex("edited_sha256")), **as_text})


def op10_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, with paragraphs cut into pieces of four words; n_lost and n_added count the recovered digests.
    Edge cases as in compare_successive."""
    return compare_successive(table(spark, sf_dir, "documents"), piece_words=4, digests=False).drop("lost", "added")
