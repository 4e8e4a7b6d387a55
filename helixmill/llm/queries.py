"""Queries of the numbered problems, and their SQL where SQL can say them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import byte_bpe, compactors, cutoffs, leaks, near_copies, overlaps, plain_text, stable_sample

_QUERIES = {
    "p1_found": near_copies.p1_found,
    "p1_groups": near_copies.p1_groups,
    "p2_sample": stable_sample.p2_sample,
    "p2_growth": stable_sample.p2_growth,
    "p3_found": overlaps.p3_found,
    "p3_report": overlaps.p3_report,
    "p3_coverage": overlaps.p3_coverage,
    "p4_found": cutoffs.p4_found,
    "p4_cutoffs": cutoffs.p4_cutoffs,
    "p5_percentiles": compactors.p5_percentiles,
    "p5_combined": compactors.p5_combined,
    "p5_within": compactors.p5_within,
    "p6_ids": byte_bpe.p6_ids,
    "p7_found": leaks.p7_found,
    "p7_items": leaks.p7_items,
    "p7_paraphrases": leaks.p7_paraphrases,
    "p8_found": plain_text.p8_found,
    "p8_plain": plain_text.p8_plain,
}
_SQL = {
    "p1_found": near_copies.P1_FOUND_SQL,
    "p1_groups": near_copies.P1_GROUPS_SQL,
    "p2_sample": stable_sample.P2_SAMPLE_SQL,
    "p2_growth": stable_sample.P2_GROWTH_SQL,
    "p3_found": overlaps.P3_FOUND_SQL,
    "p3_report": overlaps.P3_REPORT_SQL,
    "p3_coverage": overlaps.P3_COVERAGE_SQL,
    "p4_found": cutoffs.P4_FOUND_SQL,
    "p4_cutoffs": cutoffs.P4_CUTOFFS_SQL,
    "p5_within": compactors.P5_WITHIN_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
