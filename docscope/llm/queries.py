"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docscope.llm.decontamination import op10_decontamination
from docscope.llm.language_id import op4_language_id
from docscope.llm.lsh_forest import op8_minhash_near_dedup
from docscope.llm.piece_codec import op7_piece_codec
from docscope.llm.oracle import ORACLE as ORACLE
from docscope.llm.pii import op3_pii
from docscope.llm.quality_classifier import op9_quality_classifier
from docscope.llm.quality_rules import op6_quality_rules
from docscope.llm.repeat_spans import op5_repeat_spans
from docscope.llm.secret_scan import op2_secret_scan
from docscope.llm.url_filters import op1_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_secret_scan,
        op3_pii,
        op4_language_id,
        op5_repeat_spans,
        op6_quality_rules,
        op7_piece_codec,
        op8_minhash_near_dedup,
        op9_quality_classifier,
        op10_decontamination,
    )
}
