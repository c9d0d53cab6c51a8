"""Queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, neardup, topk
from .fingerprints import op6_fingerprints
from .html_text import op10_html_text
from .language import op9_language
from .licenses import op1_licenses
from .mixing import op2_mixing
from .neardup import op3_near_duplicates
from .packing import op5_packing
from .quotations import op8_quotations
from .topk import op7_topk
from .toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_fingerprints": op6_fingerprints,
    "op7_topk": op7_topk,
    "op8_quotations": op8_quotations,
    "op9_language": op9_language,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {"op1_licenses": licenses.oracle_sql(), "op3_near_duplicates": neardup.ORACLE_SQL, "op7_topk": topk.ORACLE_SQL}
