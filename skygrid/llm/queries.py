"""Registry of the corpus queries and their SQL."""

from __future__ import annotations

from . import embeddings, licenses, substrings, suffixes
from .decontamination import op4_decontamination
from .embeddings import op8_embeddings
from .packing import op1_packing
from .pii import op9_pii
from .quality import op7_quality
from .sharding import op10_sharding
from .simhash import op3_simhash
from .substrings import op2_substrings
from .suffixes import op5_suffixes


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_substrings": op2_substrings,
        "op3_simhash": op3_simhash,
        "op4_decontamination": op4_decontamination,
        "op5_suffixes": op5_suffixes,
        "op6_licenses": licenses.op6_licenses,
        "op7_quality": op7_quality,
        "op8_embeddings": op8_embeddings,
        "op9_pii": op9_pii,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict:
    return {"op2_substrings": substrings.ORACLE, "op5_suffixes": suffixes.ORACLE, "op6_licenses": licenses.oracle(), "op8_embeddings": embeddings.ORACLE}
