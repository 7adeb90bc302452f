"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercadia.llm.collocations import OP11_SQL, op11_phrase_collocations
from mercadia.llm.decontaminate import OP9_SQL, op9_benchmark_decontamination
from mercadia.llm.gru import op8_lm_score
from mercadia.llm.iblt import op10_iblt_fingerprints
from mercadia.llm.langid import op3_language_id
from mercadia.llm.licenses import OP1_SQL, op1_license_scan
from mercadia.llm.mixing import OP4_SQL, op4_source_mixing
from mercadia.llm.negatives import OP12_SQL, op12_hard_negatives
from mercadia.llm.secrets import op5_secret_scan
from mercadia.llm.simhash import op2_simhash_near_dedup
from mercadia.llm.substrings import OP7_SQL, op7_substring_dedup
from mercadia.llm.urls import OP6_SQL, op6_url_filter
from mercadia.llm.warc import OP13_SQL, op13_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan, op2_simhash_near_dedup, op3_language_id, op4_source_mixing, op5_secret_scan,
        op6_url_filter, op7_substring_dedup, op8_lm_score, op9_benchmark_decontamination, op10_iblt_fingerprints,
        op11_phrase_collocations, op12_hard_negatives, op13_warc,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Operators 2, 3, 5, 8 and 10 have none: hashes, positions, models and sketches that SQL lacks."""
    return {
        "op1_license_scan": OP1_SQL, "op4_source_mixing": OP4_SQL, "op6_url_filter": OP6_SQL,
        "op7_substring_dedup": OP7_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL,
        "op13_warc": OP13_SQL,
    }
