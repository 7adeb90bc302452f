"""Language-model scores of a gated recurrent network with class-factored softmax (operator 8)."""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, table
from mercadia.llm.langid import held_out
from mercadia.llm.tokens import utf8

UNK, END = 0, 1
_LOG10 = math.log(10)


def _inverse(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Adam:
    """Its running moments, for gradients clipped to a norm of 1."""

    def __init__(self) -> None:
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.steps = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        norm = math.sqrt(sum(float((d * d).sum()) for d in g.values()))
        self.steps += 1
        now = rate * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, d in g.items():
            d = d * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m, v = self.m.setdefault(k, np.zeros_like(d)), self.v.setdefault(k, np.zeros_like(d))
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p[k] -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


class Gru:
    """Word probabilities as class times word within class; ids in order of frequency, so classes hold words of like frequency."""

    def __init__(self, vocabulary: int, embed: int = 24, hidden: int = 32, per_class: int = 32, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.per_class, self.hidden = per_class, hidden
        classes = -(-vocabulary // per_class)
        init = lambda *shape: (r.standard_normal(shape) / math.sqrt(shape[-2])).astype(np.float32)
        self.p = {
            "E": init(vocabulary, embed) * np.float32(math.sqrt(vocabulary) * 0.1), "W": init(embed, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "U": init(hidden, 2 * hidden), "V": init(hidden, hidden), "C": init(hidden, classes), "c": np.zeros(classes, np.float32),
            "O": init(classes, hidden, per_class), "o": np.zeros((classes, per_class), np.float32),
        }
        # places of the last class that no word has
        self.dead = np.zeros((classes, per_class), np.float32)
        self.dead.ravel()[vocabulary:] = -1e9

    def copy(self) -> Gru:
        return copy.deepcopy(self)

    def inputs(self) -> np.ndarray:
        """Input parts of the gates by word of the list, with the signs and the factor that exponentials take."""
        out = self.p["E"] @ self.p["W"] + self.p["b"]
        out[:, : 2 * self.hidden] *= -1
        out[:, 2 * self.hidden :] *= -2
        return out

    def steps(self, x: np.ndarray, h: np.ndarray, gradient: bool = True, inputs: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """States over a window, and with ``gradient`` the gates; x: (time, lane) input ids."""
        p, n = self.p, self.hidden
        gates = np.take(self.inputs() if inputs is None else inputs, x, axis=0)
        out = {"h": np.empty((*x.shape, n), np.float32)}
        if gradient:
            out |= {"zr": np.empty((*x.shape, 2 * n), np.float32), "n": np.empty((*x.shape, n), np.float32)}
        by_h, by_rh = -p["U"], -2 * p["V"]
        for t in range(len(x)):
            zr = h @ by_h
            zr += gates[t, :, : 2 * n]
            zr = _inverse(zr)
            new = (zr[:, n:] * h) @ by_rh
            new += gates[t, :, 2 * n :]
            new = _inverse(new)  # tanh x is 2 / (1 + exp(-2x)) - 1
            new *= 2
            new -= 1
            if gradient:
                out["zr"][t], out["n"][t] = zr, new
            new -= h
            new *= zr[:, :n]
            h = np.add(h, new, out=out["h"][t])
        return out

    def log_probs(self, h: np.ndarray, y: np.ndarray, gradient: bool = True) -> tuple[np.ndarray, tuple]:
        """Natural log probability of each target after its state, and with ``gradient`` what that needs: targets are taken
        class by class, in the order of which the states are copied once."""
        p, of, rows = self.p, y // self.per_class, np.arange(len(y))
        order = np.argsort(of.astype(np.uint16) if len(p["c"]) < 1 << 16 else of, kind="stable")
        h, of, within = np.take(h, order, axis=0), of[order], y[order] % self.per_class
        edges = np.searchsorted(of, np.arange(len(p["c"]) + 1))
        filled = np.flatnonzero(np.diff(edges))
        classes = h @ p["C"]
        classes += p["c"]
        words = np.take(p["o"] + self.dead, of, axis=0)
        for k in filled:
            words[edges[k] : edges[k + 1]] += h[edges[k] : edges[k + 1]] @ p["O"][k]
        # exponentials of small logits need no shift
        high = max(float(h.max()), -float(h.min())) if len(h) else 0.0
        bounds = [high * float(np.abs(p[w]).sum(axis=-2).max()) + float(np.abs(p[b]).max()) for w, b in (("C", "c"), ("O", "o"))]
        logp = np.zeros(len(y), classes.dtype)
        for logits, target, bound in ((classes, of, bounds[0]), (words, within, bounds[1])):
            if bound > 80:
                logits -= logits.max(axis=1, keepdims=True)
            logp += logits[rows, target]
            np.exp(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], logits.dtype)
            logp -= np.log(total)
            if gradient:
                logits *= np.reciprocal(total, out=total)[:, None]
        out = np.empty_like(logp)
        out[order] = logp
        return out, (order, h, of, within, edges, filled, classes, words)

    def gradient(self, x: np.ndarray, y: np.ndarray, h0: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss a word, gradients and last state of one window: backpropagation stops at its begin."""
        p, n, size = self.p, self.hidden, self.per_class
        s = self.steps(x, h0)
        logp, (order, h, of, within, edges, filled, classes, words) = self.log_probs(s["h"].reshape(-1, n), y.ravel())
        g, rows, scale = {}, np.arange(len(order)), np.float32(1 / len(order))
        for d, target in ((classes, of), (words, within)):
            d[rows, target] -= 1
            d *= scale
        g["C"], g["c"] = h.T @ classes, classes.sum(axis=0)
        g["O"], g["o"] = np.zeros_like(p["O"]), np.zeros_like(p["o"])
        g["o"][filled] = np.add.reduceat(words, edges[filled], axis=0)
        dh_sorted = classes @ p["C"].T
        for k in filled:
            some = slice(edges[k], edges[k + 1])
            g["O"][k] = h[some].T @ words[some]
            dh_sorted[some] += words[some] @ p["O"][k].T
        back = np.empty_like(order)
        back[order] = rows
        dh_all = np.take(dh_sorted, back, axis=0).reshape(*x.shape, n)
        before, z, r, new = np.concatenate((h0[None].astype(np.float32), s["h"][:-1])), s["zr"][:, :, :n], s["zr"][:, :, n:], s["n"]
        # how the update, the candidate and the reset answer to their sums
        keep, reset = 1 - z, r * before
        by_z, by_n, by_r = (new - before) * z * keep, z * (1 - new * new), reset * (1 - r)
        dgates = np.empty((*x.shape, 3 * n), np.float32)
        dh = np.zeros_like(h0)
        for t in range(len(x) - 1, -1, -1):
            dh += dh_all[t]
            dn = dh * by_n[t]
            drh = dn @ p["V"].T
            dgates[t, :, :n], dgates[t, :, n : 2 * n], dgates[t, :, 2 * n :] = dh * by_z[t], drh * by_r[t], dn
            dh *= keep[t]
            drh *= r[t]
            dh += drh
            dh += dgates[t, :, : 2 * n] @ p["U"].T
        flat = dgates.reshape(-1, 3 * n)
        g["U"], g["V"] = before.reshape(-1, n).T @ flat[:, : 2 * n], reset.reshape(-1, n).T @ flat[:, 2 * n :]
        # sums by input word
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(p["E"]) < 1 << 16 else ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        sums = np.zeros((len(p["E"]), 3 * n), np.float32)
        sums[ids[first]] = np.add.reduceat(np.take(flat, order, axis=0), first, axis=0)
        g["W"], g["b"], g["E"] = p["E"].T @ sums, sums.sum(axis=0), sums @ p["W"].T
        return float(-logp.mean()), g, s["h"][-1]

    def fit(self, ids: np.ndarray, adam: Adam, rate: float = 0.01, lanes: int = 32, window: int = 24) -> list[float]:
        """One pass over successive documents, cut into lanes; states go from window to window, gradients do not. Short
        texts get fewer lanes, for some tens of steps. Every word is learned from once."""
        lanes = max(1, min(lanes, len(ids) // (window * 32)))
        length = (len(ids) - 1) // lanes
        if length < 1:
            return []
        x, y = (ids[i : i + lanes * length].reshape(lanes, length).T for i in (0, 1))
        losses, h = [], np.zeros((lanes, self.hidden), np.float32)
        for t in range(0, length, window):
            loss, g, h = self.gradient(x[t : t + window], y[t : t + window], h)
            adam.step(self.p, g, rate)
            losses.append(loss)
        rest = ids[lanes * length :]  # fewer than a word a lane; they go on from the last lane's end
        if len(rest) > 1:
            loss, g, _ = self.gradient(rest[:-1, None], rest[1:, None], h[-1:])
            adam.step(self.p, g, rate)
            losses.append(loss)
        return losses

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def take(self, values: np.ndarray) -> None:
        """Parameters from the order of flat()."""
        at = 0
        for k in sorted(self.p):
            self.p[k] = values[at : at + self.p[k].size].astype(np.float32).reshape(self.p[k].shape)
            at += self.p[k].size

    def score(self, texts: list[np.ndarray], window: int = 16, lanes: int = 512) -> np.ndarray:
        """Log10 probability of whole id sequences. Each is a lane; lanes of like length go together, longest first, so
        those that still run are the first ones; a lane's state is carried from window to window to its end. Windows get
        longer as lanes end, so that each holds about as many words, few enough for a CPU's cache."""
        out, inputs = np.zeros(len(texts)), self.inputs()
        order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
        for begin in range(0, len(order), lanes):
            some = order[begin : begin + lanes]
            sizes = np.array([len(texts[i]) for i in some])
            h = np.zeros((len(some), self.hidden), np.float32)
            t = 0
            while t < sizes[0]:
                live = int((sizes > t).sum())
                wide = min(max(window, window * lanes // live), int(sizes[0]) - t)
                y = np.full((wide, live), -1, np.int64)
                x = np.full((wide, live), END, np.int64)
                for k in range(live):
                    part = texts[some[k]][t : t + wide]
                    y[: len(part), k] = part
                    x[1 : len(part), k] = part[:-1]
                    if t:
                        x[0, k] = texts[some[k]][t - 1]
                states = self.steps(x, h[:live], gradient=False, inputs=inputs)["h"]
                real = y.ravel() >= 0
                logp, _ = self.log_probs(states.reshape(-1, self.hidden)[real], y.ravel()[real], gradient=False)
                out[some[:live]] += np.bincount(np.nonzero(y >= 0)[1], logp, minlength=live)
                h, t = states[-1], t + wide
        return out / _LOG10


def tokens_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, split at ASCII white space; and where each text's begin (one entry more)."""
    whole = pa.array(utf8(column), pa.large_binary()).cast(pa.large_string())  # of slices, the kernels lose words
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end gives an empty word
    if not real.all():
        flat, counts = flat.filter(pa.array(real)), np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
    return flat, np.r_[0, np.cumsum(counts)].astype(np.int64)


def _pieces(column: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text; a longer text stands alone and whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = done = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, done + size, "right")))
        yield begin, end
        begin, done = end, ends[end - 1]


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Of each word its place in known, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)


def _with_ends(ids: np.ndarray, first: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The ids with END after each text's, and where each text begins then."""
    n = len(first) - 1
    out = np.full(len(ids) + n, END, kind)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
    return out, first + np.arange(n + 1)


def word_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, n) over all texts; the empty word is the end, one a text. Tasks add up before anything is sent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def rows() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            yield from pa.table({"word": summed["word"].cast(pa.string()), "n": summed["n_sum"]}).combine_chunks().to_batches()

        for batch in batches:
            for low, high in _pieces(batch.column("text")):
                found = pc.value_counts(tokens_of(batch.column("text").slice(low, high - low))[0])
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                held.append(pa.table({"word": pa.array([""], pa.large_string()), "n": pa.array([high - low], pa.int64())}))
                if sum(map(len, held)) > flush:
                    yield from rows()
                    held = []
        if held:
            yield from rows()

    return docs.select("text").mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most ``most`` of the most frequent words with their counts: those of the highest classes of counts, eighths of a
    power of two wide. The end is always among them."""
    band = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band")).collect()
    least, total = None, 0
    for r in sizes:
        total += r.n
        if total > most - 1:
            break
        least = r.band
    some = counts.where((F.col("word") == "") | (band >= least if least is not None else F.lit(False)))
    return {r.word.encode(): r.n for r in some.toLocalIterator()}


def _keep_heap() -> None:
    """Once a block this large was freed, glibc keeps smaller freed ones for the next step; their page faults would take a
    third of the time."""
    np.empty(31 << 20, np.uint8)


def _learn(batches: Iterator[pa.RecordBatch], model: Gru, rate: float, kind: type, lanes: int, piece: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Truncated backpropagation over a task's texts; out come the parameters times the tokens they have seen, and those (-1)."""
    _keep_heap()
    adam, held, size, seen = Adam(), [], 0, 0
    for batch in batches:
        for ids, copies in zip(batch.column("ids").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            for _ in range(copies):
                held.append(np.frombuffer(ids, kind))
                size += len(held[-1])
                if size > piece:
                    model.fit(np.r_[END, np.concatenate(held)].astype(np.int64), adam, rate, lanes)
                    seen, held, size = seen + size, [], 0
    if size:
        model.fit(np.r_[END, np.concatenate(held)].astype(np.int64), adam, rate, lanes)
        seen += size
    if seen:
        values = np.r_[float(seen), model.flat().astype(np.float64) * seen]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(values) - 1)), pa.array(values)], ["k", "value"])


def train(model: Gru, texts: DataFrame, ids: dict[bytes, int], rates: tuple[float, ...], part_tokens: int = 1 << 21, least_tokens: int = 1 << 22, lanes: int = 256, bundle: int = 8) -> None:
    """Fit the model to all texts, a round a rate: each task learns from its texts, starting from the same parameters, and
    the results are averaged by tokens. The driver gets one sum a parameter, whatever the number of texts.

    texts: at (a number that spreads them), text. They are dealt into a share a round, so that every text is learned from
    once; where all have fewer than ``least_tokens`` tokens, rounds take several shares, at most all. There are eight parts,
    or one for part_tokens tokens where that is more; a text's share, part and place there follow from ``at``, so neither
    cores nor the order of rows matter. Equal rows are counted first and dealt out in bundles of up to ``bundle`` copies,
    so that any number of them is spread over parts."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast(ids)
    kind = np.int16 if len(ids) + 2 < 1 << 15 else np.int32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.array([*known.value.values(), UNK], kind)  # the last for places of -1
        words = pa.array(known.value.keys(), pa.binary()).cast(pa.large_string())
        for batch in batches:
            for low, high in _pieces(batch.column("text")):
                found, first = tokens_of(batch.column("text").slice(low, high - low))
                ids, first = _with_ends(numbers[_places(found, words)], first, kind)
                coded = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(first * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("at").slice(low, high - low), coded.cast(pa.binary())], ["at", "ids"])

    made = materialize(texts.select("at", "text").mapInArrow(encode, "at long, ids binary").groupBy("at", "ids").agg(F.count("*").alias("n")))
    tokens = made.agg(F.sum(F.length("ids") * F.col("n"))).first()[0] or 0
    tokens //= np.dtype(kind).itemsize
    if not tokens:
        return
    parts, shares = max(8, math.ceil(tokens / part_tokens)), len(rates)
    first = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(bundle))).alias("first")
    dealt = made.select("at", "ids", "n", first)
    place = F.pmod(F.xxhash64("at", "first"), F.lit(parts * shares))
    dealt = dealt.select(
        "at", "first", "ids", F.least(F.col("n") - F.col("first"), F.lit(bundle)).cast("int").alias("copies"),
        (place % parts).cast("int").alias("part"), F.floor(place / parts).alias("share"),
    )
    for turn, rate in enumerate(rates):
        now = spark.sparkContext.broadcast(model)
        own = [(turn + j) % shares for j in range(min(shares, math.ceil(least_tokens / tokens)))]
        # not written: files are read in parts that depend on the cores
        coded = dealt.where(F.col("share").isin(own)).repartitionById(parts, "part").sortWithinPartitions("at", "first").select("ids", "copies")
        sums = coded.mapInArrow(lambda b, now=now, rate=rate: _learn(b, now.value.copy(), rate, kind, lanes), "k long, value double").groupBy("k").agg(F.sum("value").alias("value"))
        found = np.array([r.value for r in sums.orderBy("k").collect()])
        if len(found):
            model.take(found[1:] / found[0])


def score(docs: DataFrame, training: DataFrame, shortlist: int = 1024, frequent: int = 200_000, rates: tuple[float, ...] = (0.01, 0.01, 0.005, 0.002)) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts.

    docs, training: doc_id, text. Tokens are the words, A-Z lower-cased, and one end. Word counts cover all training
    texts. The network knows the most frequent words, the end and one token for all other words; it is fitted to every
    training text by Spark tasks, whose parameters are averaged once a rate (train), and scores each text to its end. A word
    outside its list has the probability of that token times (c + 1) over
    the counts of all such words plus one each and one for all unseen, so score is of the same tokens as base_score,
    the unigram log10((c + 1) / (N + V + 1)). Counts of at most ``frequent`` words go to the tasks; other words'
    counts come by a join.

    Null texts are empty: the end alone. Null doc_ids are scored like others, repeated rows each for itself; without
    training texts all words are unseen. An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(training))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = _frequent(counts, frequent)
    order = sorted((w for w in top if w), key=lambda w: (-top[w], w))
    names = order[: shortlist - 2]
    n_listed = len(names)
    listed = sum(top[w] for w in names) + top.get(b"", 0)
    other = math.log10(n_all - listed + v_all - len(names) - (b"" in top) + 1)
    every = math.log10(n_all + v_all + 1)
    model = Gru(len(names) + 2)
    train(model, training.select(F.xxhash64("doc_id", "text").alias("at"), "text"), {w: i + 2 for i, w in enumerate(names)}, rates)
    end = math.log10(top[b""] + 1) if b"" in top else None
    known = spark.sparkContext.broadcast((model, order, np.log10([top[w] + 1.0 for w in order])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_heap()
        words, held, size = pa.array(known.value[1], pa.binary()).cast(pa.large_string()), [], 0
        for batch in batches:
            for low, high in _pieces(batch.column("text")):
                held.append(batch.slice(low, high - low))
                size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
                if size > 4 << 20:
                    yield judge(held, words)
                    held, size = [], 0
        if held:
            yield judge(held, words)

    def judge(held: list[pa.RecordBatch], known_words: pa.Array) -> pa.RecordBatch:
        model, _, logs = known.value
        words, first = tokens_of(pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in held]))
        at, sizes = _places(words, known_words), np.diff(first)
        n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        listed, seen = (at >= 0) & (at < n_listed), at >= 0
        log = np.where(seen, np.r_[logs, 0.0][at], 0.0)
        ids, starts = _with_ends(np.where(listed, at + 2, UNK), first, np.int32)
        base = np.bincount(owner, log, minlength=n) + (end or 0.0) - every * (sizes + 1)
        beyond = np.bincount(owner, np.where(listed, 0.0, log - other), minlength=n)
        n_known = np.bincount(owner, seen, minlength=n).astype(np.int64) + (end is not None)
        rare: list[list] = [[] for _ in range(n)]
        some = np.flatnonzero(~seen)
        for (i, w), k in Counter(zip(owner[some].tolist(), words.take(pa.array(some)).to_pylist(), strict=True)).items():
            rare[i].append({"word": w, "k": k})
        scores = model.score(np.split(ids, starts[1:-1]) if n else []) + beyond
        kind = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
        doc_id = pa.concat_arrays([b.column("doc_id") for b in held])
        columns = [doc_id, pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(scores), pa.array(rare, kind)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    scanned = docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,k:bigint>>")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()))
    found = scanned.select("row", F.inline("rare")).join(counts, "word")
    more = found.groupBy("row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"))
    both = scanned.drop("rare").join(more.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return both.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learned from the documents
    that are not held out; a null doc_id is learned from. Edge cases as in score."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 7, 2)
    found = score(docs, docs.where(~out))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
