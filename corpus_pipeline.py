"""The training-data pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, small_batches, table, with_rows
from mercadia.llm.decontaminate import contamination
from mercadia.llm.langid import UNKNOWN, identify
from mercadia.llm.mixing import mix
from mercadia.llm.secrets import secrets
from mercadia.llm.simhash import near_groups

_KEEP = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL has neither the automata nor the hashes of these stages; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; lang becomes the identified one.

    Null texts, those without a letter, and all if no row has a label and a text, are unidentifiable. Null and repeated
    ids are rows of their own; texts are judged whole; an empty table gives an empty result; other columns are dropped."""
    small_batches(spark)
    judged = identify(docs, docs, keep=_KEEP).where(F.col("lang_pred") != UNKNOWN)
    return judged.withColumn("lang", F.col("lang_pred")).select(*_KEEP)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of least doc_id stays, one with a null doc_id only if no other has one. Links
    are those of operator 2 (SimHashes of three words within three bits) and pairs at 0.8 of five-word shingles.

    Rows are told apart by a row id, so unlike texts of one doc_id both stay, and copies with equal or null ids leave
    one. Texts without words are copies of each other. An empty table gives an empty result."""
    small_batches(spark)
    rows = with_rows(docs.select(*_KEEP))
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = near_groups(rows).groupBy("component").agg(first.alias("_row")).select("_row")
    # the rows that stay grow with the input: never a broadcast
    return rows.join(kept.hint("merge"), "_row", "left_semi").select(*_KEEP)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten successive words of a benchmark item, or a shorter item whole, go.

    Null and empty texts hold nothing and stay; an empty benchmark drops nothing; each row is judged for itself."""
    small_batches(spark)
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=_KEEP)
    return found.where(F.size("hits") == 0).select(*_KEEP)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for x in sorted(spans or (), key=lambda x: x["start"]):
                if merged and x["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x["end"])
                else:
                    merged.append([x["start"], x["end"]])
            for start, end in reversed(merged):
                texts[i] = f"{texts[i][:start]}[secret]{texts[i][end:]}"
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(["doc_id", "text", "lang", "source"])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are masked in their texts; all documents stay. Widely copied examples stay as they are.

    Each row is masked by its own spans, whatever its doc_id: null and repeated ids, null and empty texts stay rows of
    their own. Overlapping spans are one mask. n_chars is that of the masked text. An empty table gives an empty result."""
    small_batches(spark)
    live = F.filter("spans", lambda x: x["verdict"] == "live")
    found = secrets(docs, keep=("doc_id", "text", "lang", "source")).withColumn("spans", live)
    masked = found.mapInArrow(_mask, "doc_id long, text string, lang string, source string")
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words, repeats counted. Texts without words are never taken; a null
    source is one of its own; each row counts for itself; an empty table gives an empty result."""
    return mix(docs).where("taken > 0")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("source_mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again. Edge cases as each stage states."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
