"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_byte_bpe
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .fim import OP12_SQL, op12_fill_in_middle
from .fingerprint import op7_document_fingerprints
from .jaccard import op3_ngram_jaccard
from .lattice import op8_lattice_lm
from .lines import op2_line_dedup
from .mixing import OP6_SQL, op6_mixing, op6_mixing_residuals
from .pii import op5_pii
from .quality import op4_quality_classifier
from .shards import op9_kd_shards
from .superkmers import OP11_SQL, op11_superkmer_dedup
from .turns import op13_turn_repair


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_byte_bpe, op2_line_dedup, op3_ngram_jaccard, op4_quality_classifier, op5_pii,
        op6_mixing, op7_document_fingerprints, op8_lattice_lm, op9_kd_shards, op10_exact_dedup,
        op11_superkmer_dedup, op12_fill_in_middle, op13_turn_repair,
        op6_mixing_residuals,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_superkmer_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
