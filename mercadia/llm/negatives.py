"""Hard-negative mining: scores sorted by (anchor, descending score, id) in the shuffle, streamed through open windows."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, table

#: Rows and anchors of a block: a block pair has a million scores at most.
ROWS, ANCHORS = 2048, 512
_TOP = np.iinfo(np.int64).max
_BLOCK = "ids binary, labels binary, vectors binary"
_ANCHOR = "anchor long, anchor_id long, label long, vector binary"
_PAIR = "anchor long, anchor_id long, score long, id long, row long"


def _packed(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x, allow_pickle=False)
    return out.getvalue()


def _unpacked(x: bytes) -> np.ndarray:
    return np.load(io.BytesIO(x), allow_pickle=False)


def _whole(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a vector is there with finite components only, and floor(scale * component) of those that are, padded with
    0 to the longest. Whole numbers beyond 15 bits stay doubles, which hold them exactly."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = ~np.isfinite(flat)
    with np.errstate(over="ignore"):
        flat = np.floor(scale * np.where(bad, 0, flat))
    bad |= ~np.isfinite(flat)
    fine = there & (np.bincount(owner[bad], minlength=len(lengths)) == 0)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    out = out[fine]
    return fine, out.astype(np.int16) if not out.size or np.abs(out).max() < 1 << 15 else out


def _pack(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, label, vector) to blocks, each in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                fine, vectors = _whole(part.column("vector"), scale)
                if fine.any():
                    ids, labels = (part.column(c).to_numpy(zero_copy_only=False)[fine].astype(np.int64) for c in ("id", "label"))
                    order = np.argsort(ids, kind="stable")
                    yield pa.RecordBatch.from_arrays([pa.array([_packed(x[order])], pa.binary()) for x in (ids, labels, vectors)], ["ids", "labels", "vectors"])

    return run


def _anchors(every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of blocks whose id is divisible by every."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *parts in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "labels", "vectors")), strict=True):
                ids, labels, vectors = map(_unpacked, parts)
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block * ROWS + at), pa.array(ids[at]), pa.array(labels[at]), pa.array([_packed(vectors[k]) for k in at], pa.binary())],
                    ["anchor", "anchor_id", "label", "vector"],
                )

    return run


def _anchor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, each with its windows (from, to), to blocks."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ANCHORS):
            part = batch.slice(begin, ANCHORS)
            vectors = [_unpacked(v) for v in part.column("vector").to_pylist()]
            out = np.zeros((len(vectors), max(map(len, vectors))), np.result_type(*vectors))
            for k, v in enumerate(vectors):
                out[k, : len(v)] = v
            low, high = part.column("low").to_pylist(), part.column("high").to_pylist()
            windows = np.zeros((2, len(low), max(map(len, low))), np.int64)
            windows[0] = 1  # above its end: an empty window
            for k, (a, b) in enumerate(zip(low, high, strict=True)):
                windows[0, k, : len(a)], windows[1, k, : len(b)] = a, b
            columns = [part.column(c).to_numpy() for c in ("anchor", "anchor_id", "label")]
            yield pa.RecordBatch.from_arrays([pa.array([_packed(x)], pa.binary()) for x in (*columns, out, windows)], ["anchors", "anchor_ids", "anchor_labels", "anchor_vectors", "windows"])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b as 64-bit integers, exact; beyond 64 bits the largest or least of those.
    A shorter vector counts as padded with 0."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    bound = max(np.linalg.norm(x.astype(np.float64), axis=1).max(initial=0) for x in (a, b)) ** 2 * 1.01
    if bound < 1 << 24:  # every partial sum is below by Cauchy-Schwarz, so floating point is exact
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b.tolist()] for u in a.tolist()]
    return np.array([[min(max(x, -_TOP - 1), _TOP) for x in r] for r in exact], np.int64).reshape(len(a), len(b))


def _kept(found: tuple[np.ndarray, ...], windows: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of candidates (anchor, score, id, row) those among the first n of one of their anchor's windows."""
    order = np.lexsort((found[3], found[2], -1 - found[1], found[0]))  # -1 - x can't overflow
    found = tuple(x[order] for x in found)
    at, score = found[:2]
    first = np.searchsorted(at, at)
    keep = np.zeros(len(at), bool)
    for k in range(windows.shape[2]):
        inside = (score >= windows[0, at, k]) & (score <= windows[1, at, k])
        before = np.r_[0, np.cumsum(inside)]
        keep |= inside & (before[1:] - before[first] <= n)
    return tuple(x[keep] for x in found)


def _scan(same: bool, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Score blocks of rows against blocks of anchors and keep the first n rows of each window: of the anchor's label if
    same, else of other labels. What is kept is carried over successive blocks of the same anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, None

        def out():
            at, score, ids, rows = found
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (now[0][at], now[1][at], score, ids, rows)], ["anchor", "anchor_id", "score", "id", "row"])

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                of = [_unpacked(r[c]) for c in ("anchors", "anchor_ids", "anchor_labels", "anchor_vectors", "windows")]
                if now is None or not np.array_equal(now[0], of[0]):
                    if found and len(found[0]):
                        yield out()
                    now, found = of, tuple(np.zeros(0, np.int64) for _ in range(4))
                ids, labels, vectors = (_unpacked(r[c]) for c in ("ids", "labels", "vectors"))
                rows = r["block"] * ROWS + np.arange(len(ids))
                s = scores(now[3], vectors)
                low, high = now[4][0], now[4][1]
                fits = ((labels[None, :] == now[2][:, None]) == same) & (rows[None, :] != now[0][:, None])
                if same and len(found[0]):  # what is below the n-th so far can't come in
                    least = np.full(len(low), -_TOP - 1)
                    full = np.bincount(found[0], minlength=len(low)) >= n
                    worst = np.full(len(low), _TOP)
                    np.minimum.at(worst, found[0], found[1])
                    fits &= s >= np.where(full, worst, least)[:, None]
                elif not same:
                    live = low <= high
                    fits &= (s >= np.where(live, low, _TOP).min(1)[:, None]) & (s <= np.where(live, high, -_TOP - 1).max(1)[:, None])
                a, b = np.nonzero(fits)
                new = a, s[a, b], ids[b], rows[b]
                found = _kept(tuple(np.concatenate(x) for x in zip(found, new, strict=True)), now[4], n)
        if found and len(found[0]):
            yield out()

    return run


def _windows(n: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores sorted by anchor, descending score, positives first, id: a positive opens a window that reaches down to num/den of
    its score; a negative goes out once for each window that holds it, until that has n. Only open windows are held."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for batch in batches:
            rows = []
            for anchor, anchor_id, score, kind, id_ in zip(*(batch.column(c).to_pylist() for c in ("anchor", "anchor_id", "score", "kind", "id")), strict=True):
                if anchor != now:
                    now, open_ = anchor, []
                if kind == 0:
                    open_.append([id_, score, -(-score * num // den), 0])
                    continue
                open_ = [w for w in open_ if w[2] <= score and w[3] < n]
                for w in open_:
                    w[3] += 1
                    rows.append((anchor_id, w[0], w[3], id_, w[1], score))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return run


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """For each anchor and each of its first positives: the first negatives that score at most as high and at least
    share of it.

    vectors: vec_id, label, embedding. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Components become floor(scale * x); a score is their inner product. Anchors are the rows whose
    vec_id is divisible by every, positives the first other rows of their label, negatives rows of another label;
    higher scores first, ties by vec_id.

    Blocks of anchors meet blocks of rows by an equi-join on groups of row blocks; anchors are copied to at most 64
    groups, or one a million rows, so copies stay below the rows while those are fewer than 64 million. Each task keeps
    a few rows of each anchor and window: by the rest of the rows these can only be driven out. Positives come first, as
    their scores are the windows of the negatives. Both go to their anchor's partition, sorted within it, where an
    iterator with the open windows alone reads them.

    Rows without vec_id, label or vector, or with a component that is null or not finite (also after scaling), take no
    part. Repeated rows are rows of their own: each is listed, and each repeated anchor is served, with equal rows as
    positives. Empty vectors score 0, shorter ones count as padded with 0, scores beyond 64 bits as the largest or
    least of 64 bits. An anchor without positives or negatives gives no row, like a positive score below 0. An empty
    table gives an empty result; extra columns are ignored.
    """
    num, den = share
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    blocks = materialize(rows.mapInArrow(_pack(scale), _BLOCK).withColumn("block", F.monotonically_increasing_id()))
    anchors = materialize(blocks.mapInArrow(_anchors(every), _ANCHOR))
    n_blocks, n_anchors = blocks.count(), anchors.count()
    groups = min(max(n_blocks, 1), max(64, n_blocks // 512))
    grouped = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def met(wanted: DataFrame, same: bool, n: int) -> DataFrame:
        packed = wanted.repartition(max(1, -(-n_anchors // ANCHORS))).mapInArrow(_anchor_blocks, "anchors binary, anchor_ids binary, anchor_labels binary, anchor_vectors binary, windows binary")
        copies = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("group", F.col("group").cast("long"))
        return copies.hint("merge").join(grouped, "group").drop("group").mapInArrow(_scan(same, n), _PAIR)

    whole = anchors.withColumn("low", F.array(F.lit(-_TOP - 1).cast("long"))).withColumn("high", F.array(F.lit(_TOP)))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    found = materialize(met(whole, True, positives).withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"))
    rest = F.pmod("score", F.lit(den))  # ceil(score * num / den), by parts that stay within 64 bits
    low = F.expr(f"bigint((score - pmod(score, {den})) div {den})") * num + F.ceil(rest * num / den)
    bounds = found.groupBy("anchor").agg(F.collect_list(low).alias("low"), F.collect_list("score").alias("high"))
    mined = met(anchors.join(bounds, "anchor"), False, negatives)
    columns = ("anchor", "anchor_id", "score", "kind", "id", "row")
    both = found.withColumn("kind", F.lit(0)).select(*columns).unionByName(mined.withColumn("kind", F.lit(1)).select(*columns))
    ordered = both.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id", "row")
    return ordered.mapInArrow(_windows(negatives, num, den), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of embeddings, labels moved on by one (modulo 10) where vec_id is divisible by 7. Edge cases
    as in hard_negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


OP12_SQL = """
WITH rows AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (
  SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label,
         CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.v, b.v)]) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
