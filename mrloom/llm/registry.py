"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import best_fit, decontaminate, filter_audit, html_extract, jaccard_join, periodic_runs, quality_rules, reshard, secret_scan, soft_mixing, substring_dedup, token_counts, topk_search


def queries():
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_soft_mixing": soft_mixing.op2_soft_mixing,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_reshard": reshard.op4_reshard,
        "op5_topk_search": topk_search.op5_topk_search,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_best_fit": best_fit.op12_best_fit,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql():
    return {
        "op1_secret_scan": secret_scan.SQL,
        "op3_substring_dedup": substring_dedup.SQL,
        "op5_topk_search": topk_search.SQL,
        "op6_jaccard_join": jaccard_join.SQL,
        "op9_html_extract": html_extract.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op11_filter_audit": filter_audit.SQL,
    }
