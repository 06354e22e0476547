"""The queries of this subpackage and the SQL that some must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_alignment
from .chat import OP9_SQL, op9_chat
from .decontaminate import OP10_SQL, op10_decontaminate
from .embeddings import OP8_SQL, op8_embeddings
from .html import op4_html
from .packing import op7_packing
from .personal import op12_personal
from .phrases import OP13_SQL, op13_phrases
from .quality import op1_quality
from .simhash import op5_simhash
from .toxicity import op2_toxicity
from .urls import op6_urls
from .warc import OP3_SQL, op3_warc

QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_quality,
    op2_toxicity,
    op3_warc,
    op4_html,
    op5_simhash,
    op6_urls,
    op7_packing,
    op8_embeddings,
    op9_chat,
    op10_decontaminate,
    op11_alignment,
    op12_personal,
    op13_phrases,
)
SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op8_embeddings": OP8_SQL, "op9_chat": OP9_SQL, "op10_decontaminate": OP10_SQL, "op13_phrases": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
