"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from .decontaminate import OP9_SQL, op9_decontaminate
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .langid import op6_language_id
from .license_scan import op3_license_scan
from .ngram_join import OP4_SQL, op4_ngram_join
from .packing import op5_packing
from .pii import op2_pii
from .repair import op10_token_files
from .secrets import op7_secrets
from .substring_dedup import op8_substring_dedup

QUERIES: dict[str, Callable] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_join": op4_ngram_join,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_secrets": op7_secrets,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_files": op10_token_files,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op4_ngram_join": OP4_SQL, "op9_decontaminate": OP9_SQL}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
