"""The queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideway.llm import arrow_files, decontaminate, html, licences, middles, mixtures, packing, quality, repeats, runs, secrets, simhash, url_filters

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_near_dedup,
        decontaminate.op2_benchmark_decontamination,
        secrets.op3_secret_scans,
        arrow_files.op4_token_id_output,
        quality.op5_quality_rules,
        html.op6_html_extraction,
        licences.op7_license_scans,
        packing.op8_best_fit_packing,
        url_filters.op9_url_filters,
        repeats.op10_suffix_array_dedup,
        runs.op11_periodic_runs,
        mixtures.op12_language_id,
        middles.op13_fill_in_middle,
    )
}
ORACLES = {
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_license_scans": licences.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op10_suffix_array_dedup": repeats.ORACLE,
    "op11_periodic_runs": runs.ORACLE,
    "op13_fill_in_middle": middles.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
