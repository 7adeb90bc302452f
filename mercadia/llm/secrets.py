"""Secret scans: candidates judged by how many repositories and owners hold them (operator 5)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, table, with_columns
from mercadia.llm.tokens import text_chunks

KINDS = ("assign", "access", "hex", "owned")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_CANDIDATES = "array<struct<kind:int,start:int,end:int,value:string>>"
_CANDIDATES_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def candidates(text: str) -> list[dict]:
    """Base matches by kind, then bare tokens that look random and meet no base match."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(0, m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    if any(len(x) >= 20 for x in text.split()):
        out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
        base = [(s, e) for _, s, e, _ in out]
        for m in _BARE.finditer(text):
            v = m[0]
            if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= 3.5 and not any(s < m.end() and m.start() < e for s, e in base):
                out.append((3, m.start(), m.end(), v))
    return [dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in out]


_SPANS = "array<struct<start:int,kind:int,end:int,value_hash:string,repos:bigint,owners:bigint,verdict:string>>"


def secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", example_owners: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Candidate credentials of each text with the verdict that their spread over the corpus gives.

    docs: text and the columns named by repo, owner and keep. Returns the columns named by keep and spans: an array of
    (kind, start, end, value_hash, repos, owners, verdict) by start, then kind; code points, end exclusive. Kinds:
    0 assign, 1 access, 2 hex (the base), 3 owned. Candidate values are hashed and counted over all documents by
    distinct repositories and owners: a value of example_owners owners or more is widely copied, an 'example'; any
    other is 'live'. Base spans stay whatever the verdict; a bare random-looking token outside all base spans
    becomes a span (owned) only if it is live. Counts are of pairs made distinct before they are shuffled by value,
    so a value that a third of all documents hold is summed in parts. Only rows with candidates are joined to their
    verdicts, by a row id; all others pass through unshuffled.

    Null texts are empty and have no spans; null repositories or owners count as one of their own. Repeated rows
    are the same repository. An empty table gives an empty result. Texts of any length are whole. Extra columns
    are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(t.decode()) if t else [] for _, _, texts in text_chunks(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "_repo", "_owner")), pa.array(found, _CANDIDATES_ARROW)], [*keep, "_repo", "_owner", "_found"])

    side = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(name) for c, name in ((repo, "_repo"), (owner, "_owner"))]
    rows = docs.select(*dict.fromkeys((*keep, "text")), *side)
    hashed = F.transform("_found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("value_hash")))
    scanned = materialize(rows.mapInArrow(scan, with_columns(docs, keep, f"_repo string, _owner string, _found {_CANDIDATES}")).withColumn("_row", F.monotonically_increasing_id()).withColumn("_found", hashed))
    each = scanned.select("_row", "_repo", "_owner", F.inline("_found"))
    held = each.select("value_hash", "_owner", "_repo").distinct()
    spread = (
        held.groupBy("value_hash", "_owner").agg(F.count("*").alias("repos"))
        .groupBy("value_hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))
    )
    judged = (
        each.join(spread, "value_hash")
        .withColumn("verdict", F.when(F.col("owners") >= example_owners, "example").otherwise("live"))
        .where((F.col("kind") < 3) | (F.col("verdict") == "live"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value_hash", "repos", "owners", "verdict"))).alias("spans"))
    )
    none = F.array().cast(_SPANS)
    clean = scanned.where(F.size("_found") == 0).select(*keep, none.alias("spans"))
    # rows with candidates grow with the input: never a broadcast
    other = scanned.where(F.size("_found") > 0).select(*keep, "_row").join(judged.hint("merge"), "_row", "left").select(*keep, F.coalesce("spans", none).alias("spans"))
    return clean.unionByName(other)


def _joined(spans):
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: counts of the base kinds, base_sha256, spans, n_live. A document is a repository, its source the
    owner. Edge cases as in secrets."""
    found = secrets(table(spark, sf_dir, "documents"))

    def of_kind(k: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [of_kind(k) for k in range(3)]
    live = F.size(F.filter("spans", lambda x: x["verdict"] == "live")).cast("long").alias("n_live")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), live)
