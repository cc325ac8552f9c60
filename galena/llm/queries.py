"""The queries of this subpackage and the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP9_SQL, op9_chat
from .decontamination import op10_decontamination
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .language import op6_language
from .licenses import op7_licenses
from .lm_scoring import OP1_SQL, op1_lm_scoring
from .mixing import op8_mixing
from .near_dedup import op4_simhash
from .toxicity import op2_toxicity
from .warc import OP5_SQL, op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_language": op6_language,
    "op7_licenses": op7_licenses,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_lm_scoring": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op9_chat": OP9_SQL,
}
