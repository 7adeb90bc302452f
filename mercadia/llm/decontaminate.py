"""Benchmark decontamination by winnowed fingerprints (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, table, with_columns, with_rows
from mercadia.llm.tokens import Words, byte_values, mix, sliding_min, spans_of, text_chunks, words

_VALUES = byte_values(lower=True, alnum=True)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ADDED = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Fingerprints:
    """The benchmark's anchors and windows, sorted by hash. Items shorter than a window are windows of their own length."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int) -> None:
        self.window, self.gram, self.names = window, gram, sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.of = np.array([number[i] for i, _ in items], np.int64)  # rows of one id are one item
        w = words([t.encode() for _, t in items], _VALUES)
        n = np.diff(w.first)
        at = np.flatnonzero(w.whole(window))
        self.anchors = np.unique(anchors(w, window, gram)[at])
        self.by_length = {window: self._sorted(w, at, window)} if len(at) else {}
        for short in sorted({int(x) for x in n if 0 < x < window}):
            self.by_length[short] = self._sorted(w, w.first[:-1][n == short], short)

    def _sorted(self, w: Words, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows by hash with their words, where each one's items begin, and these, each once."""
        sequence = w.hash[at[:, None] + np.arange(n)]
        keyed = np.c_[w.grams(n)[at], sequence]
        item = self.of[w.doc[at]]
        order = np.lexsort((item, *keyed.T[::-1]))
        keyed, item = keyed[order], item[order]
        new = np.r_[True, (keyed[1:] != keyed[:-1]).any(axis=1)]
        once = new | np.r_[True, item[1:] != item[:-1]]
        return keyed[new, 0], keyed[new, 1:], np.r_[np.flatnonzero(new[once]), once.sum()], item[once]

    def match(self, w: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which words lie in an occurrence, and per found occurrence (text, item), each once a window length."""
        hit, found, doc = np.zeros(len(w.hash) + 1, np.int32), [], w.doc
        for n, (keys, sequences, first, items) in self.by_length.items():
            if n == self.window:  # an anchor shared with the benchmark is the seed
                at = np.flatnonzero(w.whole(n) & among(anchors(w, n, self.gram), self.anchors))
            else:
                at = np.flatnonzero(w.whole(n))
            key = w.grams(n)[at]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            some = high > low
            which, entry = _spread(low[some], high[some])
            at = at[some]
            if not len(at):
                continue
            same = (w.hash[at[which][:, None] + np.arange(n)] == sequences[entry]).all(axis=1)
            which, entry = which[same], entry[same]
            np.add.at(hit, at[which], 1)
            np.add.at(hit, at[which] + n, -1)
            pairs = np.unique(np.stack((doc[at[which]], entry)), axis=1)
            which, place = _spread(first[pairs[1]], first[pairs[1] + 1])
            found.append(np.unique(np.stack((pairs[0][which], items[place])), axis=1))
        return np.cumsum(hit[:-1]) > 0, found


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low to high: the range and the place of each of their members."""
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count - low, count)


def anchors(w: Words, window: int, gram: int) -> np.ndarray:
    """The least gram hash in the window from each word on: equal windows have equal anchors."""
    return sliding_min(w.grams(gram), window - gram + 1)


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 4, broadcast_bytes: int = 64 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words of documents that lie in a window of a benchmark item.

    docs: doc_id, text and the kept columns; benchmark: item_id, text. Returns the columns named by keep, n_words, hits (runs of hit words, end exclusive) and
    items (item_ids as text, distinct, unordered). Each window keeps its least gram hash as anchor, so any shared
    span of ``window`` words shares an anchor; where anchors meet, the hit is extended to whole windows and compared
    word by word. A benchmark whose tables take up to broadcast_bytes goes to the tasks whole and documents are read
    once, without a shuffle; a larger one is joined by two independent 64-bit hashes of each window, with the same result.
    A window that an item repeats, or that many items share, is one entry of these tables.

    Null or empty texts have no words and no hits; items without id or words match nothing; an empty benchmark hits
    nothing; an empty table of documents gives an empty result. Repeated rows are judged each for itself. Texts of
    any length are whole. Extra columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    # a word gives a window: its hash, those of its words, an item and an anchor; the text is held while they are made
    built = F.sum(F.octet_length("text") + F.regexp_count("text", F.lit(_WORD)) * (8 * window + 32))
    if (items.agg(built).first()[0] or 0) > broadcast_bytes:
        return _joined(with_rows(docs.select(*dict.fromkeys((*keep, "text")))), items, window, keep)
    known = spark.sparkContext.broadcast(Fingerprints([(r.item_id, r.text) for r in items.collect()], window, gram))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = known.value
        for batch in batches:
            for low, high, texts in text_chunks(batch.column("text")):
                w = words(texts, _VALUES)
                hit, found = prints.match(w)
                hits: list[list] = [[] for _ in range(high - low)]
                names: list[list] = [[] for _ in range(high - low)]
                if found:
                    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                    for d, i in pairs.T.tolist():
                        names[d].append(prints.names[i])
                    for d in np.unique(pairs[0]).tolist():
                        hits[d] = [{"start": s, "end": e} for s, e in spans_of(hit[w.first[d] : w.first[d + 1]])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in keep), pa.array(np.diff(w.first).astype(np.int64)), pa.array(hits, _HITS), pa.array(names, pa.list_(pa.string()))],
                    [*keep, "n_words", "hits", "items"],
                )

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(scan, with_columns(docs, keep, _ADDED))


def _joined(docs: DataFrame, items: DataFrame, window: int, keep: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of any size: windows of both sides meet by (length, hash, check). docs has a unique _row.

    A place in a document meets a window once, however many items hold it; items come by the sets of items that a
    document has met, so k items that share a window met in m places are not k times m rows."""

    def rows(name: str, lengths: list[int] | None):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(name)
                for low, high, texts in text_chunks(batch.column("text")):
                    w = words(texts, _VALUES)
                    again = Words(w.start, w.end, mix(w.hash + np.uint64(1)), w.first)
                    n_of, doc = np.diff(w.first), w.doc
                    for n in lengths if lengths is not None else sorted({min(int(x), window) for x in n_of if x}):
                        whole = w.whole(n)
                        if lengths is None and n < window:
                            whole = whole & (n_of[doc[: len(whole)]] == n)
                        at = np.flatnonzero(whole)
                        if not len(at):
                            continue
                        yield pa.RecordBatch.from_arrays(
                            [ids.slice(low, high - low).take(pa.array(doc[at])), pa.array(at - w.first[doc[at]]), pa.array(np.full(len(at), n)), *(pa.array(x.grams(n)[at].view(np.int64)) for x in (w, again))],
                            [name, "start", "n", "hash", "check"],
                        )

        return scan

    key, of = ["n", "hash", "check"], ["k", "x", "y"]
    windows = materialize(items.mapInArrow(rows("item_id", None), "item_id string, start long, n long, hash long, check long").select("item_id", *key).distinct())
    classes = item_classes(windows)
    lengths = [r.n for r in windows.select("n").distinct().collect()]  # at most as many as a window has words
    there = docs.select("_row", "text").mapInArrow(rows("_row", lengths), "_row long, start long, n long, hash long, check long")
    met = materialize(there.join(classes, key).select("_row", "start", "n", *of))  # a row a place: the other side is unique
    first = classes.groupBy(*of).agg(F.min(F.struct(*key)).alias("_window")).select(*of, "_window.*")
    members = first.join(windows, key).select(*of, "item_id")
    names = met.select("_row", *of).distinct().join(members, of).groupBy("_row").agg(F.collect_set("item_id").alias("_items"))
    per_row = runs_of(met).join(names, "_row")
    counted = docs.select(*keep, "_row", F.regexp_count("text", F.lit(_WORD)).alias("_n"))
    return counted.join(per_row, "_row", "left").select(
        *keep, F.coalesce("_n", F.lit(0)).cast("long").alias("n_words"), F.coalesce("_hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
    )


def item_classes(windows: DataFrame) -> DataFrame:
    """(n, hash, check, k, x, y): each distinct window once; windows of the same items have the same k, x and y, the number
    of items and two 64-bit hashes of their set, so that no list of items is made.

    windows: item_id, n, hash, check, each row once."""
    return windows.groupBy("n", "hash", "check").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("item_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "item_id")).alias("y"))


def runs_of(places: DataFrame) -> DataFrame:
    """(_row, _hits): the places of a row, each n words from start on, as runs that neither overlap nor touch. Running
    maxima over sorted places, so a long text with many places is sorted, not held."""
    each = places.groupBy("_row", "start").agg((F.col("start") + F.max("n")).alias("end"))
    before = Window.partitionBy("_row").orderBy("start")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opened = each.withColumn("_opens", F.when(reach >= F.col("start"), 0).otherwise(1))
    run = F.sum("_opens").over(before.rowsBetween(Window.unboundedPreceding, 0))
    runs = opened.withColumn("_run", run).groupBy("_row", "_run").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"))
    return runs.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_hits"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, ten-word windows: n_words, n_hit, n_items, items_sha256, contaminated; edge cases as in contamination."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_tokens AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_tokens WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tokens, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
met AS (SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.s = t.s AND d.n = t.n),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM met GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tokens t LEFT JOIN covered c ON t.doc_id = c.doc_id LEFT JOIN named n ON t.doc_id = n.doc_id
"""
