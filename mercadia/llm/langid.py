"""Language identification by cross-parsing against suffix automata (operator 3)."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm.common import discard, materialize, table, with_columns
from mercadia.llm.tokens import text_chunks

UNKNOWN = "und"
_END = np.int32(1 << 29)  # added to a transition for each phrase that it ends
_BLOCK = 512
_NO_LETTERS = re.compile(r"[\W\d_]+")


@functools.cache
def _others() -> np.ndarray:
    """By code point: whether it is no letter."""
    out = np.zeros(0x110000, bool)
    for m in _NO_LETTERS.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters; each run of other characters is one space. Those say little about a language."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    other = _others()[points]
    keep = np.ones(len(points), bool)
    keep[1:] = ~(other[1:] & other[:-1])
    return np.where(other, 32, points)[keep]


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether a document is kept out of learning: by the crc32 of its id as text. A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(False))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state and symbol of the automaton that accepts all substrings. State 0 is the start."""
    links, lengths, rows = [-1], [0], [{}]
    last = 0
    for c in symbols:
        now = len(rows)
        rows.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in rows[p]:
            rows[p][c] = now
            p = links[p]
        if p >= 0:
            q = rows[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[now] = q
            else:
                twin = len(rows)
                rows.append(dict(rows[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and rows[p].get(c) == q:
                    rows[p][c] = twin
                    p = links[p]
                links[q] = links[now] = twin
        last = now
    return rows


class Automaton:
    """One language's suffix automaton. A step gives the next state, and _END for each phrase that it ends.

    Symbols are numbered by frequency in the sample, from 2 on; 0 is padding and changes nothing, 1 any letter that the
    sample lacks: a phrase of its own. The first ``width`` symbols have a table; all other transitions, of the rarer
    letters of a large alphabet, are searched for in one sorted list. A symbol that cannot extend the phrase ends it and
    begins the next.
    """

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        rows = suffix_automaton(symbols.tolist())
        self.size = int(symbols.max(initial=1)) + 1
        self.width = min(max(2, width), self.size)
        self.bits = math.log2(len(symbols) + 2)
        state = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        symbol = np.fromiter((c for r in rows for c in r), np.int64, len(state))
        to = np.fromiter((s for r in rows for s in r.values()), np.int64, len(state))
        self.first = np.zeros(self.size, np.int32)
        self.first[symbol[state == 0]] = to[state == 0]
        ended = np.where(np.arange(len(rows)) == 0, 0, _END)[:, None]
        table = self.first[: self.width][None, :] + np.repeat(ended, self.width, axis=1)
        table[:, 0] = np.arange(len(rows))
        table[:, 1] += _END
        near = symbol < self.width
        table[state[near], symbol[near]] = to[near]
        self.table = table.astype(np.int32).ravel()
        key = state[~near] * self.size + symbol[~near]
        order = np.argsort(key)
        self.key, self.to = key[order], to[~near][order].astype(np.int32)

    def step(self, state: np.ndarray, symbols: np.ndarray, rare: bool) -> np.ndarray:
        if not rare:
            return self.table.take(state * self.width + symbols)
        far = symbols >= self.width
        moved = self.table.take(state * self.width + np.where(far, 0, symbols))
        at = np.flatnonzero(far)
        key = state[at].astype(np.int64) * self.size + symbols[at]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        moved[at] = np.where(self.key[place] == key, self.to[place], self.first[symbols[at]] + _END)
        return moved

    def phrases(self, lanes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that end in each lane (a row a step), where a lane that follows goes on from the state of the one before.

        All lanes are parsed from the start first. Then those whose true first state is another are parsed again, side by
        side with what they took before, until both meet; if they don't, the next lane has a new first state too.
        """
        rare = (lanes >= self.width).any(axis=1)
        state, ends = np.zeros(lanes.shape[1], np.int32), np.zeros(lanes.shape[1], np.int32)
        for symbols, r in zip(lanes, rare, strict=True):
            moved = self.step(state, symbols, r)
            ends += moved >> 29
            state = moved & (_END - 1)
        begun = np.zeros_like(state)
        while True:
            true = np.where(follows, np.r_[np.int32(0), state[:-1]], np.int32(0))
            at = np.flatnonzero(true != begun)
            if not len(at):
                break
            was, now = begun[at], true[at]
            begun = true
            for symbols, r in zip(lanes, rare, strict=True):
                one, other = self.step(was, symbols[at], r), self.step(now, symbols[at], r)
                ends[at] += (other >> 29) - (one >> 29)
                was, now = one & (_END - 1), other & (_END - 1)
                apart = was != now
                if not apart.all():
                    at, was, now = at[apart], was[apart], now[apart]
                if not len(at):
                    break
            state[at] = now
        last = ~np.r_[follows[1:], False]
        return ends + (last & (state != 0))  # the phrase that the text's end cuts


class Parser:
    """The automata of some languages, each over the alphabet of its own sample, with tables of at most table_bytes in all."""

    def __init__(self, samples: dict[str, str], table_bytes: int = 64 << 20) -> None:
        self.langs = sorted(samples)
        texts = {k: letters(t) for k, t in samples.items()}
        seen = np.unique(np.concatenate([np.zeros(1, np.uint32), *texts.values()]))
        self.symbol = np.zeros(0x110000, np.int32)  # of all samples together; 0 for a letter that none has
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        # a sample of n letters has at most 2n states
        width = min(56, table_bytes // (8 * max(1, sum(map(len, texts.values())))))
        self.own, self.automata = [], []
        for lang in self.langs:
            found, counts = np.unique(self.symbol[texts[lang]], return_counts=True)
            own = np.ones(len(seen) + 2, np.int32)
            own[found[np.lexsort((found, -counts))]] = np.arange(2, len(found) + 2)
            own[-1] = 0
            self.own.append(own)
            self.automata.append(Automaton(own[self.symbol[texts[lang]]], width))

    def bits_of(self, texts: list[str]) -> np.ndarray:
        """(text, language): phrases needed, times the bits that name a place in the language's sample.

        Texts are parsed whole, in lanes of 512 letters whose states are carried over (Automaton.phrases)."""
        coded = [self.symbol[letters(t)] for t in texts]
        blocks = [-(-len(s) // _BLOCK) for s in coded]
        lanes = np.full((sum(blocks), _BLOCK), -1, np.int32)  # the last entry of own: padding
        flat, at = lanes.ravel(), 0
        for s, n in zip(coded, blocks, strict=True):
            flat[at : at + len(s)] = s
            at += n * _BLOCK
        owner = np.repeat(np.arange(len(texts)), blocks)
        follows = np.r_[False, owner[1:] == owner[:-1]][: len(owner)]
        steps = np.ascontiguousarray(lanes.T)
        out = np.zeros((len(texts), len(self.langs)))
        for k, (own, automaton) in enumerate(zip(self.own, self.automata, strict=True)):
            out[:, k] = np.bincount(owner, automaton.phrases(own[steps], follows), minlength=len(texts)) * automaton.bits
        return out


def training_sample(docs: DataFrame, sample_docs: int, sample_chars: int, max_langs: int) -> dict[str, str]:
    """Per language its distinct texts of least hashes, at most sample_docs of them and sample_chars characters in all. A
    text that crosses the limit is cut to what is left, so a language with long texts only, or a long one first, is learned
    in full; repeated rows count once.

    Only hashes are ranked, and each task hands on a few a language; the chosen texts, 24 MB at most for 1,000 languages,
    are read in a second pass."""
    texts = docs.where("lang is not null and text is not null and text != ''").select("lang", F.substring("text", 1, sample_chars).alias("text"))
    texts = texts.withColumn("point", F.xxhash64("text"))
    points = texts.select("lang", "point").distinct()
    chosen = points.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("point"))).where(F.col("rank") <= sample_docs)
    chosen = materialize(chosen)
    if chosen.where("rank = 1").limit(max_langs + 1).count() > max_langs:
        raise ValueError(f"over {max_langs} languages; clean the labels or raise max_langs")
    # at most sample_docs short rows a language
    found = texts.join(F.broadcast(chosen), ["lang", "point"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = found.withColumn("left", F.lit(sample_chars) - before).where("left > 0").select("lang", "rank", F.col("text").substr(F.lit(1), F.col("left").cast("int")).alias("text"))
    out: dict[str, list[str]] = {}
    for r in cut.orderBy("lang", "rank").toLocalIterator():
        out.setdefault(r.lang, []).append(r.text)
    discard(chosen)
    return {lang: "\n".join(found) + "\n" for lang, found in out.items()}


def identify(docs: DataFrame, labelled: DataFrame, sample_docs: int = 64, sample_chars: int = 24_000, max_langs: int = 1000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named by keep, then lang_pred and score: the language whose sample parses the text into the fewest normalised phrases.

    docs: text and the kept columns; labelled: doc_id, text, lang. From labelled rows at most sample_docs texts and sample_chars
    characters a language are learned (the bound of the fit), of at most max_langs languages (more raise); every text is then judged whole. A phrase is the longest
    run of the rest of the text that occurs in the sample, where texts and samples are their letters; phrases count log2(sample length) bits each. score is the
    saving over the second best language, 0 to 1 (1 if only one is known).

    'und' with score 0 if the text is null or has no letter, or no language was learned. Ties go to the language
    first by code point. Null labels or texts teach nothing, repeated rows are judged each for itself, an empty table
    gives an empty result, extra columns are ignored.
    """
    samples = training_sample(labelled, sample_docs, sample_chars, max_langs)
    known = docs.sparkSession.sparkContext.broadcast(Parser(samples)) if samples else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_chunks(batch.column("text"), 2 << 20):
                kept = [batch.column(c).slice(low, high - low) for c in keep]
                judged = _judge(known.value if known else None, [t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays([*kept, *judged], [*keep, "lang_pred", "score"])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(scan, with_columns(docs, keep, "lang_pred string, score double"))


def _judge(parser: Parser | None, texts: list[str]) -> tuple[pa.Array, pa.Array]:
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if parser else []
    if some:
        bits = parser.bits_of([texts[i] for i in some])
        best = bits.argmin(axis=1)
        ordered = np.sort(bits, axis=1)
        saved = 1 - ordered[:, 0] / ordered[:, 1] if bits.shape[1] > 1 else np.ones(len(some))
        for k, i in enumerate(some):
            langs[i], scores[i] = parser.langs[best[k]], saved[k]
    return pa.array(langs), pa.array(scores)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. Learned from the documents that are not held out; a null
    doc_id is learned from. Edge cases as in identify."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    found = identify(docs, docs.where(~out))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
