"""SimHash near-duplicates by the generalised pigeonhole principle (operator 2)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, table, with_rows
from mercadia.llm.components import components
from mercadia.llm.tokens import Words, byte_values, mix, text_chunks, words

BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit by bit the majority over the text's shingles, as a signed 64-bit number; 0 without words."""
    w = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    hashed, join = xxhash.xxh64_digest, b" ".join
    digests = b"".join([hashed(join(w[i : i + shingle]), 42) for i in range(n)])
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), 8 << 16):
        ones += np.unpackbits(np.frombuffer(digests[at : at + (8 << 16)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the whole text's SimHash as a long. Null and wordless texts have 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for _, _, texts in text_chunks(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the most significant first."""
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _numbers(bits: np.ndarray) -> np.ndarray:
    """The same for up to 64 bits."""
    padded = np.concatenate((np.zeros((len(bits), BITS - bits.shape[1]), np.uint8), bits), axis=1)
    return np.packbits(padded, axis=1).reshape(-1, 8).copy().view(">i8").ravel().astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch], parts: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """How often a bit pair is set together, and how often a byte of a partition's bits has each value."""
    both = np.zeros((BITS, BITS), np.int64)
    cells = {(p, k): np.zeros(256, np.int64) for p, bits in enumerate(parts) for k in range(-(-len(bits) // 8))}
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 14):
            bits = _bits(batch.column("fp").slice(at, 1 << 14).to_numpy(zero_copy_only=False))
            if not parts:
                both += (bits.T.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
            for (p, k), counts in cells.items():
                counts += np.bincount(_numbers(bits[:, parts[p][8 * k : 8 * k + 8]]), minlength=256)
    rows = [(-1, i, j, both[i, j]) for i in range(BITS) for j in range(BITS)] if not parts else [(p, k, v, c[v]) for (p, k), c in cells.items() for v in range(256) if c[v]]
    yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in rows], pa.int64()) for i in range(4)], ["p", "i", "j", "n"])


def _counts(classes: DataFrame, parts: list[list[int]]) -> list:
    """Sums over all fingerprints: 4,096 rows, or at most 256 a byte."""
    scanned = classes.select("fp").mapInArrow(lambda batches: _scan(batches, parts), "p long, i long, j long, n long")
    return scanned.groupBy("p", "i", "j").agg(F.sum("n").alias("n")).collect()


def correlated_parts(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of the bits, each grown from its first free bit by the bits that correlate most with it."""
    mean = together.diagonal() / max(1, n)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((together / max(1, n) - np.outer(mean, mean)) / np.outer(sd, sd))
    free, parts = list(range(BITS)), []
    for k in range(m):
        part = [free.pop(0)]
        while len(part) < BITS // m + (k < BITS % m):
            best = max(free, key=lambda b: (corr[part, b].sum(), -b))
            free.remove(best)
            part.append(best)
        parts.append(sorted(part))
    return parts


def allocate(pairs_at: list[list[float]], probes: list[list[float]], radius: int, top: int = 1) -> tuple[float, list[int]]:
    """Thresholds t of -1..top a partition with sum radius - m + 1, of least cost, by dynamic programming.

    Any two fingerprints within the radius differ by at most t bits in some partition: else they differed by
    sum(t + 1) = radius + 1 bits. pairs_at[i][t + 1]: candidates that partition i is expected to give at t;
    probes[i][t + 1]: rows to send for it.
    """
    m, want = len(pairs_at), radius + 1  # t + 1 sums to radius + 1
    best: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
    for i in range(m):
        now: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, chosen) in best[-1].items():
            for t in range(-1, top + 1):
                if had + t + 1 <= want:
                    new = cost + pairs_at[i][t + 1] + probes[i][t + 1]
                    if had + t + 1 not in now or new < now[had + t + 1][0]:
                        now[had + t + 1] = (new, [*chosen, t])
        best.append(now)
    return best[-1].get(want, (float("inf"), []))


def plan(classes: DataFrame, radius: int, sizes: tuple[int, ...] | None = None) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds, from counts over all fingerprints; sizes: numbers of partitions to
    choose from (all that allow thresholds of at most 1, if none are given).

    How far two fingerprints lie apart within a partition is estimated from the value counts of its bytes, taken as
    independent. A probe row weighs 30 candidate comparisons. Both only steer cost: any allocation finds every pair.
    """
    n = classes.count()
    together = np.zeros((BITS, BITS))
    for r in _counts(classes, []):
        together[r.i, r.j] = r.n
    popcount = np.array([bin(x).count("1") for x in range(256)])
    apart = popcount[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
    choices = []
    for m in sizes or range(-(-(radius + 1) // 2), radius + 2):
        parts = correlated_parts(together, n, m)
        cells: dict[tuple[int, int], np.ndarray] = {}
        for r in _counts(classes, parts):
            cells.setdefault((r.p, r.i), np.zeros(256))[r.j] = r.n / max(1, n)
        pairs_at, probes = [], []
        for p, bits in enumerate(parts):
            near = np.ones(1)
            for k in range(-(-len(bits) // 8)):
                h = cells.get((p, k), np.eye(256)[0])
                near = np.convolve(near, np.bincount(apart.ravel(), np.outer(h, h).ravel(), minlength=9))
            within = np.cumsum(near)
            pairs_at.append([0.0, n * n / 2 * within[0], n * n / 2 * within[1]])
            probes.append([0.0, 30.0 * n, 30.0 * n * (1 + len(bits) / 2)])
        choices.append((*allocate(pairs_at, probes, radius), parts))
    _, thresholds, parts = min(choices, key=lambda c: c[0])
    return parts, thresholds


def _probes(batches: Iterator[pa.RecordBatch], parts: list[list[int]], thresholds: list[int]) -> Iterator[pa.RecordBatch]:
    """A row for each partition and own value (d = 0); with threshold 1 also for each value with one more bit set (d = 1).

    Of two values one bit apart, the one without that bit comes to the other's, so each pair meets once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 12):
            fps, reps = (batch.column(c).slice(at, 1 << 12).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            bits = _bits(fps)
            for p, t in enumerate(thresholds):
                if t < 0:
                    continue
                own = bits[:, parts[p]]
                value = _numbers(own)
                who, where = np.nonzero(own == 0) if t else (np.zeros(0, int), np.zeros(0, int))
                key = np.r_[value, value[who] | (np.int64(1) << (own.shape[1] - 1 - where).astype(np.int64))]
                all_ = np.r_[np.arange(len(fps)), who]
                d = np.r_[np.zeros(len(fps), np.int8), np.ones(len(who), np.int8)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), p, np.int8)), pa.array(key), pa.array(d), pa.array(fps[all_]), pa.array(reps[all_])], ["part", "value", "d", "fp", "rep"]
                )


def _shells(batches: Iterator[pa.RecordBatch], parts: list[list[int]], radius: int) -> Iterator[pa.RecordBatch]:
    """For members of crowded buckets: the values near their remaining bits.

    Members that hold the bucket's value (d = 0) take all values up to radius - 1 bits away, the others those up to
    radius - 2. Two members are within the radius just if, for some value, one holder is at most 1 bit away and the
    other member radius - 1 (radius - 2, if it has one bit in the bucket) at most; then all members there are linked
    with that holder. That is the case for any holder within 1 bit, so one of them stands for all."""
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "d", "fp", "rep")]
        for part, value, d, fp, rep in zip(*(c.tolist() for c in cols), strict=True):
            rest = [b for b in range(BITS) if b not in parts[part]]
            masks = [1 << (BITS - 1 - b) for b in rest]
            inside = sum(1 << (BITS - 1 - b) for b in parts[part])
            base = (fp & (2**64 - 1)) & ~inside
            near, at = [], []
            for flips in range(radius - d):
                for some in itertools.combinations(masks, flips):
                    near.append((base ^ sum(some)) - (2**64 if base ^ sum(some) >= 2**63 else 0))
                    at.append(flips)
            n = len(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int8)), pa.array(np.full(n, value, np.int64)), pa.array(near, pa.int64()), pa.array(np.array(at) + 10 * d, pa.int8()), pa.array(np.full(n, rep, np.int64))],
                ["part", "value", "near", "how", "rep"],
            )


def links(classes: DataFrame, radius: int = 3, crowd: int = 128, sizes: tuple[int, ...] | None = None) -> DataFrame:
    """(a, b): links between representatives whose closure joins just those within ``radius`` bits.

    classes: fp, rep, one row a fingerprint. Buckets of up to ``crowd`` holders of a value are compared pair by
    pair, so each row meets a bounded number of others. In larger ones, the remaining bits decide (see _shells):
    a value's neighbourhood has a bounded number of fingerprints, so no group grows with the data there either.
    """
    if radius < 2:
        raise ValueError("a radius of 2 or more")
    parts, thresholds = plan(classes, radius, sizes)
    rows = classes.mapInArrow(lambda b: _probes(b, parts, thresholds), "part byte, value long, d byte, fp long, rep long")
    own = classes.mapInArrow(lambda b: _probes(b, parts, [min(t, 0) for t in thresholds]), "part byte, value long, d byte, fp long, rep long")
    crowded = materialize(own.groupBy("part", "value").count().where(F.col("count") > crowd).select("part", "value"))
    any_crowded = not crowded.isEmpty()
    one, other = (x.join(crowded, ["part", "value"], "left_anti") if any_crowded else x for x in (own, rows))
    one, other = one.alias("x"), other.alias("y")
    met = (
        (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value")) & ((F.col("y.d") == 1) | (F.col("x.rep") < F.col("y.rep")))
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
    )
    found = one.join(other, met).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    if any_crowded:
        many = rows.join(crowded, ["part", "value"], "left_semi").repartition(rows.sparkSession.sparkContext.defaultParallelism * 8)
        near = many.mapInArrow(lambda b: _shells(b, parts, radius), "part byte, value long, near long, how byte, rep long")
        # how: bits away; from 10 on, of a member with one bit in the bucket
        hubs = near.groupBy("part", "value", "near").agg(
            F.min(F.when(F.col("how") <= 1, F.col("rep"))).alias("hub"), F.collect_set("rep").alias("members")
        )
        stars = hubs.where(F.col("hub").isNotNull() & (F.size("members") > 1)).select(F.col("hub").alias("a"), F.explode("members").alias("b"))
        found = found.unionByName(stars.where("a != b"))
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, crowd: int = 128) -> DataFrame:
    """(doc_id, fp, component_id): documents linked at ``radius`` or fewer differing bits, and the least doc_id reachable.

    docs: doc_id, text. Texts are lower-cased (A-Z), their word shingles (repeats included; fewer words: the whole
    sequence) hashed, and each bit set if most hashes have it. Equal fingerprints are one class before anything is
    compared, so exact copies are never paired.

    Null, empty and wordless texts have fingerprint 0 and are linked like any others. Rows with a null doc_id are
    fingerprinted; their class has the least doc_id that is not null, or null. Repeated rows are kept, an empty
    table gives an empty result, texts of any length are whole, extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes.where("rep is not null"), radius, crowd))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


_VALUES = byte_values(lower=True, alnum=False)


def _shingles(w: Words, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the n-word shingles of all texts, in order, and where each text's begin; a shorter text is one
    shingle. bits: how many of a hash are kept."""
    sizes = np.diff(w.first)
    at = np.flatnonzero(w.whole(n))
    key, owner = w.grams(n)[at], w.doc[at]
    for short in range(1, n):
        some = np.flatnonzero(sizes == short)
        key, owner = np.r_[key, w.grams(short)[w.first[some]]], np.r_[owner, some]
    key = key.view(np.int64) >> (64 - bits)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.searchsorted(owner[new], np.arange(len(sizes) + 1))


def signatures(rows: DataFrame, shingle: int, bands: int, depth: int) -> DataFrame:
    """(doc_id, _row, key, key2, size, buckets): two hashes and the size of the text's set of shingles, and a hash of
    ``depth`` minima of the set for each of ``bands`` bands."""
    seeds = mix(np.arange(1, bands * depth + 1, dtype=np.uint64) << np.uint64(32))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_chunks(batch.column("text")):
                key, first = _shingles(words(texts, _VALUES), shingle)
                key, size = key.view(np.uint64), np.diff(first)
                full = np.flatnonzero(size)
                sums, buckets = np.zeros((2, high - low), np.uint64), np.zeros((len(full), bands), np.uint64)
                if len(full):
                    for k in range(2):
                        sums[k, full] = np.add.reduceat(mix(key + np.uint64(k + 1)), first[full])
                    for i, s in enumerate(seeds):
                        least = np.minimum.reduceat((key ^ s) * (s | np.uint64(1)), first[full])
                        buckets[:, i // depth] = mix(buckets[:, i // depth] + least + np.uint64(i))
                held = np.zeros(high - low, np.int32)
                held[full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)], pa.int32()), pa.array(buckets.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in ("doc_id", "_row")), *(pa.array(x.view(np.int64)) for x in sums), pa.array(size.astype(np.int64)), lists],
                    ["doc_id", "_row", "key", "key2", "size", "buckets"],
                )

    return rows.select("doc_id", "_row", "text").mapInArrow(scan, "doc_id long, _row long, key long, key2 long, size long, buckets array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the whole set of shingle hashes of each row, 32 bits each: of a million shingles some hundred
    collide with another text's, far less than any similarity is asked to."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_chunks(batch.column("text")):
                key, first = _shingles(words(texts, _VALUES), shingle, 32)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(key.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(low, high - low), lists], ["node", "shingles"])

    return rows.select("_row", "text").mapInArrow(scan, "node long, shingles array<int>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those pairs whose whole sets have the similarity; n and m are their sizes. Sets of too different sizes are
    not fetched. The sets come by merge joins, which split a set that most pairs ask for."""
    asked = pairs.where(F.least("n", "m") + 1e-9 >= similarity * F.greatest("n", "m")).select("a", "b").distinct()
    both = asked.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    judged = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return judged.where(F.col("common") + 1e-9 >= similarity * (F.col("total") - F.col("common"))).select("a", "b")


def _prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n, m): all pairs of members of different components that can have the similarity, by their rarest shingles.

    With the shingles of all members in one order, two sets of the similarity share one of the first
    size - ceil(similarity * size) + 1 of each. The rarest come first, so a passage that all members share is not among
    them. Shingles of one component only join nothing, and a first common shingle so late that the rest cannot suffice
    ends a pair before it is made."""
    nodes = members.select("node", "size", "component").distinct()
    held = nodes.join(sets.hint("merge"), "node").select("node", "size", "component", F.explode("shingles").alias("shingle"))
    spread = held.groupBy("shingle").agg(F.count("*").alias("n"), (F.min("component") != F.max("component")).alias("joins"))
    ordered = held.join(spread.hint("merge"), "shingle").groupBy("node", "size", "component").agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "joins"))).alias("at"))
    length = F.size("at") - F.ceil(F.size("at") * similarity - 1e-9).cast("int") + 1
    first = ordered.select("node", "component", "at", F.posexplode(F.slice("at", 1, length)).alias("place", "it")).where("it.joins")
    first = first.select("node", "component", F.size("at").alias("size"), "it.shingle", (F.size("at") - F.col("place")).alias("rest"))
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    # all that two sets have in common comes from their first common shingle on
    near = F.least("x.rest", "y.rest") + 1e-6 >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size"))
    pairs = first.alias("x").join(first.alias("y").hint("merge"), met & near)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.size").alias("n"), F.col("y.size").alias("m")).distinct()


def _bucket_links(members: DataFrame, sets: DataFrame, similarity: float, turns: int) -> DataFrame:
    """(a, b): links that join all members of a bucket that pairs of the similarity join.

    Pairs within one component need no comparison. So each bucket's members are compared with a leader, then those of
    other components with the next leader, ``turns`` times; each leader is the member of most buckets, as the text is
    from which the others derive. A leader that has had its turn has met all, so what is left is between the others:
    where those lie in several components, they are compared by their rarest shingles (_prefix_pairs).
    """
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    members = members.join(degree.hint("merge"), "node").select("bucket", "node", "size", "degree", F.lit(False).alias("led"), F.col("node").alias("component"))
    members, linked = materialize(members), None
    for turn in range(turns + 1):
        rank = F.when(~F.col("led"), F.struct("degree", F.xxhash64("bucket", "node")))
        left = F.when(~F.col("led"), F.col("component"))
        lead = F.max_by(F.struct("node", "size", "component"), rank).alias("lead")
        open_ = materialize(members.groupBy("bucket").agg(F.min(left).alias("low"), F.max(left).alias("high"), lead).where("low != high").select("bucket", "lead"))
        if open_.isEmpty():
            break
        if turn == turns:
            rest = members.where("not led").join(open_.hint("merge"), "bucket", "left_semi")
            found = _similar(_prefix_pairs(rest, sets, similarity), sets, similarity)
            return materialize(found if linked is None else linked.unionByName(found))
        members = members.join(open_.hint("merge"), "bucket")
        others = members.where("not led and component != lead.component")
        pairs = others.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"), F.col("lead.size").alias("n"), F.col("size").alias("m"))
        found = _similar(pairs, sets, similarity)
        groups = components(found if linked is None else linked.unionByName(found))
        linked = materialize(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        named = linked.select(F.col("a").alias("of"), F.col("b").alias("now")).hint("merge")
        led = F.col("led") | (F.col("node") == F.col("lead.node"))
        members = materialize(members.join(named, F.col("node") == F.col("of"), "left").select("bucket", "node", "size", "degree", led.alias("led"), F.coalesce("now", "node").alias("component")))
    return linked if linked is not None else members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def near_groups(rows: DataFrame, similarity: float = 0.8, compare: int = 5, bands: int = 20, depth: int = 5, turns: int = 2, shingle: int = 3, radius: int | None = 3) -> DataFrame:
    """(doc_id, _row, component): the rows of one component are linked by SimHashes of ``shingle`` words that differ in
    ``radius`` bits or fewer (near_duplicates), or by pairs of at least ``similarity`` (near_copies); the latter alone, if
    radius is None.

    rows: doc_id, text and a unique _row that is the same whenever it is read.
    """
    every = materialize(signatures(rows, compare, bands, depth))
    sets_of = ["key", "key2", "size"]
    classes = materialize(every.groupBy(*sets_of).agg(F.min("_row").alias("node"), F.first("buckets").alias("buckets")))
    held = classes.select(F.explode("buckets").alias("bucket"), "node", "size")
    shared = held.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1").select("bucket")
    members = materialize(held.join(shared.hint("merge"), "bucket"))
    asked = members.select(F.col("node").alias("_row")).distinct()
    sets = materialize(shingle_sets(rows.join(asked.hint("merge"), "_row", "left_semi"), compare))
    linked = _bucket_links(members, sets, similarity, turns)
    of_set = classes.select(*(F.col(c).alias(f"{c}_") for c in sets_of), "node")
    same = [F.col(c) == F.col(f"{c}_") for c in sets_of]
    named = materialize(every.select("doc_id", "_row", *sets_of).join(of_set.hint("merge"), same).select("doc_id", "_row", "node"))
    if radius is not None:
        near = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), shingle, radius).select(F.col("doc_id").alias("of"), "component_id")
        # a link for each class and SimHash component that share rows, so copies are not expanded
        linked = linked.unionByName(named.join(near.hint("merge"), F.col("_row") == F.col("of")).where("node != component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b")).distinct())
    found = components(linked).withColumnRenamed("node", "of").hint("merge")
    return named.join(found, F.col("node") == F.col("of"), "left").select("doc_id", "_row", F.coalesce("component", "node").alias("component"))


def near_copies(docs: DataFrame, similarity: float = 0.8, compare: int = 5, bands: int = 20, depth: int = 5, turns: int = 2) -> DataFrame:
    """(doc_id, component_id): documents linked at a Jaccard similarity of ``compare``-word shingles of at least ``similarity``.

    docs: doc_id, text, lower-cased (A-Z). Equal sets of shingles are one class before anything is paired. Candidates
    are classes whose sets have equal minima under all ``depth`` hash functions of some of ``bands`` bands: a pair at
    0.8 meets with a probability of 1 - (1 - 0.8 ** 5) ** 20 = 0.9996, a closer one with a higher. Each is
    kept by the share of its whole sets. Members of a bucket are compared with leaders in turn, then by their rarest
    shingles where components are left apart (_bucket_links): no link there is lost, and no bucket is paired out.

    Null, empty and wordless texts are copies of each other. component_id is the least doc_id of the group, null if it
    has none; repeated rows are kept; an empty table gives an empty result; extra columns are ignored.
    """
    found = materialize(near_groups(with_rows(docs.select("doc_id", "text")), similarity, compare, bands, depth, turns, radius=None))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, three-word shingles and three bits: doc_id, fingerprint, component_id. Edge cases as in
    near_duplicates."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
