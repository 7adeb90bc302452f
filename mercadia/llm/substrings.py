"""Repeated passages by winnowed anchors, extended both ways (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, table
from mercadia.llm.tokens import byte_values, mix, sliding_min, text_chunks, words

_VALUES = byte_values(lower=False, alnum=False)
#: Bytes of a window's hash that travel. A bucket of hashes holds the windows of some megabytes of text, at any size of
#: the input, so two unlike windows of one bucket are alike in these with a chance of about one in a million a bucket.
_WIDE = 7
_PACKED = "bucket int, doc binary, part binary, start binary, n binary, windows binary, found boolean"


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDE]


def _widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _WIDE, 8), np.uint8)
    out[:, :_WIDE] = np.frombuffer(raw, np.uint8).reshape(-1, _WIDE)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of some counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have the key of an entry with a smaller document."""
    order = np.lexsort((doc, key))
    k = key[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    least = np.repeat(doc[order][begin], np.diff(np.r_[begin, len(k)]))
    out = np.zeros(len(key), bool)
    out[order] = doc[order] > least
    return out


def _runs(*columns: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where runs begin: some column changes, or the position does not go up by one."""
    new = np.r_[True, step[1:] != step[:-1] + 1]
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pack(bucket: int, doc, part, start, n, windows, found: bool) -> list:
    return [bucket, doc.astype("<i8").tobytes(), part.astype("<i4").tobytes(), start.astype("<i4").tobytes(), n.astype("<i4").tobytes(), windows, found]


class _Sent:
    """Windows that many documents of a chunk had, with the least document for which this task has sent each: later
    documents have them found at once, so a passage of a third of all documents travels once a task, not once a chunk.

    Forgetting them all, once they are many, costs volume only."""

    def __init__(self, copies: int = 4, most: int = 1 << 20) -> None:
        self.copies, self.most = copies, most
        self.key, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def before(self, window: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(window), bool)
        at = np.minimum(np.searchsorted(self.key, window), len(self.key) - 1)
        return (self.key[at] == window) & (self.doc[at] < doc)

    def add(self, window: np.ndarray, doc: np.ndarray) -> None:
        order = np.lexsort((doc, window))
        key, doc = window[order], doc[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[begin, len(key)]) >= self.copies
        key, doc = np.r_[self.key, key[begin[many]]], np.r_[self.doc, doc[begin[many]]]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.r_[True, key[1:] != key[:-1]][: len(key)]
        self.key, self.doc = (key[first], doc[first]) if first.sum() <= self.most else (key[:0], doc[:0])


def _windows(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: text, first word, hash, and anchor, the least of the window's gram hashes."""
    w = words(texts, _VALUES)
    at = np.flatnonzero(w.whole(length))
    owner = w.doc[at]
    return owner, at - w.first[owner], w.grams(length)[at], sliding_min(w.grams(gram), length - gram + 1)[at]


def _seeds(texts: list[bytes], ids: np.ndarray, part: np.ndarray, length: int, gram: int, buckets: int, hot: np.ndarray, sent: _Sent) -> Iterator[list]:
    """Rows of the texts' windows, by bucket of their anchors.

    A window is ``length`` words. Successive windows of one anchor are the ways in which that seed extends to the left
    and to the right, and travel as one run. Those of a hot anchor travel each for itself, to the bucket of its own
    hash. A window that a smaller document among these texts has is found at once and need not travel: whoever has it
    there has it too."""
    owner, start, window, anchor = _windows(texts, length, gram)
    if not len(owner):
        return
    doc = ids[owner]
    here = repeated(window, doc) | sent.before(window, doc)
    sent.add(window, doc)
    if here.any():
        o, s = owner[here], start[here]
        begin = _runs(o, step=s)
        yield _pack(int(window[0] % np.uint64(buckets)), ids[o[begin]], part[o[begin]], s[begin], np.diff(np.r_[begin, len(s)]), b"", True)
    send = ~here
    owner, window, anchor, start = owner[send], window[send], anchor[send], start[send]
    if not len(owner):
        return
    if len(hot):
        single = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        anchor = np.where(single, mix(window ^ np.uint64(0x5BD1E995)), anchor)
    begin = _runs(owner, anchor, step=start)
    n = np.diff(np.r_[begin, len(start)])
    to = (mix(anchor[begin]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    begin, n, to = begin[order], n[order], to[order]
    narrow, first = _narrow(window), np.r_[0, np.cumsum(n)]
    windows = narrow[np.repeat(begin, n) + _within(n)]
    o, s = owner[begin], start[begin]
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield _pack(int(to[i]), ids[o[i:j]], part[o[i:j]], s[i:j], n[i:j], windows[first[i] : first[j]].tobytes(), False)


def hot_anchors(docs: DataFrame, length: int, gram: int, chunk_bytes: int, hot_runs: int, every: int) -> np.ndarray:
    """Anchors of over hot_runs runs of windows, or of a millionth of all runs where that is more: at most a million.

    Estimated over one document in ``every``, by a hash of its id, so it does not matter how documents are dealt to tasks.
    They only steer where windows meet, not which are found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_chunks(batch.column("text"), chunk_bytes):
                owner, start, _, anchor = _windows(texts, length, gram)
                if len(owner):
                    key, n = np.unique(anchor[_runs(owner, anchor, step=start)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = some.select("text").mapInArrow(scan, "anchor long, n long").groupBy("anchor").agg((F.sum("n") * every).alias("n"))
    counts = materialize(counts.where(F.col("n") > hot_runs))  # few: a total over these suffices for the bound
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = [r.anchor for r in counts.where(F.col("n") > total / 1_000_000).select("anchor").toLocalIterator()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _extend(group: pa.Table) -> pa.Table:
    """Found runs of windows (doc_id, part, start, n) of one bucket."""
    out, parts = [], []
    for r in group.select([c.split()[0] for c in _PACKED.split(", ")]).to_pylist():
        doc, part = np.frombuffer(r["doc"], "<i8"), np.frombuffer(r["part"], "<i4")
        start, n = np.frombuffer(r["start"], "<i4"), np.frombuffer(r["n"], "<i4")
        if r["found"]:
            out.append((doc, part, start, n))
        else:
            parts.append((doc, part, start, n, _widen(r["windows"])))
    if parts:
        doc, part, start, n, window = (np.concatenate(x) for x in zip(*parts, strict=True))
        far = repeated(window, np.repeat(doc, n))
        run, at = np.repeat(np.arange(len(n)), n)[far], (np.repeat(start, n) + _within(n))[far]
        if len(run):
            begin = _runs(run, step=at)
            out.append((doc[run[begin]], part[run[begin]], at[begin], np.diff(np.r_[begin, len(run)])))
    columns = [np.concatenate([np.asarray(x[i], t) for x in out] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, np.int32, np.int32, np.int32))]
    return pa.table(dict(zip(("doc_id", "part", "start", "n"), (pa.array(c) for c in columns), strict=True)))


def repeats(docs: DataFrame, length: int = 13, gram: int = 5, bucket_bytes: int = 4 << 20, chunk_bytes: int = 2 << 20, hot_runs: int = 100_000, every: int = 16) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): the maximal runs of words (start, end) that repeat a smaller document's,
    and the other words, joined by one space.

    docs: doc_id, text. A word is in a span if one of the windows of ``length`` words around it also starts in a
    document with a smaller doc_id. Winnowing keeps the least gram hash of each window as its anchor, so two
    documents that share ``length`` words share an anchor; anchors are joined, and each is extended to the left and
    right by comparing the windows that hold it. Windows that meet or overlap are merged into maximal spans.

    Each task sends a window only for the smallest document of a chunk (chunk_bytes of text), and one that many of them
    hold once (_Sent), so a passage that a third of all documents hold comes to its bucket once a task. Buckets are as
    many as the text needs (bucket_bytes of text each). The windows of an anchor that texts hold in ever other contexts
    are dealt by their own hashes (hot_anchors), so no bucket grows with such an anchor.

    Null and empty texts, and those shorter than a window, have no spans. Rows with a null doc_id neither lose
    words nor make others lose them. Rows with equal doc_id do not count as smaller than each other and are judged
    each for itself. An empty table gives an empty result. Texts of any length are whole; extra columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, math.ceil(size / bucket_bytes))
    # rows of equal doc_id are told apart by their texts; those of equal text lose the same words
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int").alias("part"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(rows.where("doc_id is not null"), length, gram, chunk_bytes, hot_runs, every))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            ids, part = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("part").to_numpy()
            for low, high, texts in text_chunks(batch.column("text"), chunk_bytes):
                found = list(_seeds(texts, ids[low:high], part[low:high], length, gram, buckets, hot.value, sent))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), *(pa.binary(),) * 5, pa.bool_()))], [c.split()[0] for c in _PACKED.split(", ")]
                    )

    spans = (
        rows.where("doc_id is not null").mapInArrow(scan, _PACKED)
        .groupBy("bucket").applyInArrow(_extend, "doc_id long, part int, start int, n int")
        .groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
        .withColumnsRenamed({"doc_id": "of", "part": "of_part"})
    )
    joined = rows.join(spans, (F.col("doc_id") == F.col("of")) & (F.col("part") == F.col("of_part")), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(lambda b: _merge(b, length), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in text_chunks(batch.column("text"), 1 << 20):
            counts, removed, spans, kept = [], [], [], []
            for text, runs in zip(texts, batch.column("runs").slice(low, high - low).to_pylist(), strict=True):
                w = text.split()
                merged: list[dict] = []
                for s, e in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in runs or ()):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], e)
                    else:
                        merged.append({"start": s, "end": e})
                counts.append(len(w))
                for x in reversed(merged):
                    del w[x["start"] : x["end"]]
                removed.append(counts[-1] - len(w))
                spans.append(merged)
                kept.append(b" ".join(w).decode())
            columns = [batch.column("doc_id").slice(low, high - low), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "spans", "kept"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, windows of 13 words: doc_id, n_words, n_removed, kept_sha256. Edge cases as in repeats."""
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH tokens AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM tokens WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS doc_id FROM windows GROUP BY s HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos
  FROM (SELECT x.doc_id, x.i FROM windows x JOIN least y ON x.s = y.s WHERE y.doc_id < x.doc_id)),
each AS (
  SELECT t.doc_id, t.i, t.word, c.pos IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM tokens) t
  LEFT JOIN covered c ON t.doc_id = c.doc_id AND t.i = c.pos),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM each GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM tokens t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
