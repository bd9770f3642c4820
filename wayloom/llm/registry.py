"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm import decontaminate, exact_dedup, html_text, language, mixing, quality, simhash, substring, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_mixing": mixing.op3_mixing,
        "op4_simhash": simhash.op4_simhash,
        "op5_html": html_text.op5_html,
        "op6_language": language.op6_language,
        "op7_quality": quality.op7_quality,
        "op8_substring": substring.op8_substring,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op8_substring": substring.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
    }
