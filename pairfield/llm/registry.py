"""The subpackage's queries and their SQL for the entry module."""

from __future__ import annotations

from functools import wraps

from ..session import ship
from . import audio, language_id, licenses, line_dedup, mixing, ngram_join, packing, periodic_runs, quality_rules, spot_signatures, suffix_dedup, toxicity, vector_codes


def _shipped(query):
    """The query, after the package has been sent to the executors (for the Python workers)."""

    @wraps(query)
    def run(spark, sf_dir):
        return query(ship(spark), sf_dir)

    return run


def queries() -> dict:
    return {
        "op1_packing": _shipped(packing.op1_packing),
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_audio_fingerprints": _shipped(audio.op4_audio_fingerprints),
        "op5_mixing": mixing.op5_mixing,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_language_id": _shipped(language_id.op7_language_id),
        "op8_suffix_dedup": _shipped(suffix_dedup.op8_suffix_dedup),
        "op9_toxicity": _shipped(toxicity.op9_toxicity),
        "op10_ngram_join": _shipped(ngram_join.op10_ngram_join),
        "op11_vector_codes": _shipped(vector_codes.op11_vector_codes),
        "op12_spot_signatures": _shipped(spot_signatures.op12_spot_signatures),
        "op13_periodic_runs": _shipped(periodic_runs.op13_periodic_runs),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE,
        "op3_quality_rules": quality_rules.ORACLE,
        "op5_mixing": mixing.ORACLE,
        "op6_license_scan": licenses.ORACLE,
        "op11_vector_codes": vector_codes.ORACLE,
        "op13_periodic_runs": periodic_runs.ORACLE,
    }
