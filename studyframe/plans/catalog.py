"""Registry of the study queries run by the driver: Spark builders and their SQL oracles."""

from __future__ import annotations

from . import agreement as ag
from . import checks as ck
from . import cleaning as cl
from . import inference as inf
from . import modelling as md
from . import profiling as pf
from . import records as rc
from . import reporting as rp
from . import screening as sc

# name -> (builder, oracle SQL or None)
_ENTRIES = {
    "agreement_by_ship_day": (ag.agreement_by_ship_day, ag.AGREEMENT_SQL),
    "agreement_match_rates": (ag.match_rates, ag.MATCH_RATES_SQL),
    "party_union": (cl.party_union, cl.PARTY_SQL),
    "party_csv_ingest": (cl.party_csv_ingest, cl.PARTY_SQL),
    "priority_clean_counts": (cl.priority_clean_counts, cl.PRIORITY_SQL),
    "priority_schema_audit": (cl.priority_schema_audit, cl.PRIORITY_AUDIT_SQL),
    "events_typed": (cl.events_typed, cl.EVENTS_TYPED_SQL),
    "events_rejected": (cl.events_rejected, cl.EVENTS_REJECTED_SQL),
    "calendar_parts": (cl.calendar_parts, cl.CALENDAR_SQL),
    "events_stream_calendar": (cl.events_stream_calendar, cl.CALENDAR_SQL),
    "customer_missing_flags": (cl.customer_missing_flags, cl.CUSTOMER_FLAGS_SQL),
    "customer_shape": (cl.customer_shape, cl.CUSTOMER_SHAPE_SQL),
    "document_dup_masks": (rc.document_dup_masks, rc.DOC_DUP_MASKS_SQL),
    "document_dup_report": (rc.document_dup_report, rc.DOC_DUP_REPORT_SQL),
    "document_dedupe": (rc.document_dedupe, rc.DOC_DEDUPE_SQL),
    "conversation_encounters": (rc.conversation_encounters, rc.CONV_ENCOUNTERS_SQL),
    "document_attrition": (rc.document_attrition, rc.DOC_ATTRITION_SQL),
    "document_cohort": (rc.document_cohort, rc.DOC_COHORT_SQL),
    "document_headline": (rc.document_headline, rc.DOC_HEADLINE_SQL),
    "document_target_counts": (rc.document_target_counts, rc.DOC_TARGET_COUNTS_SQL),
    "lineitem_numeric_profile": (pf.lineitem_numeric_profile, pf.LINEITEM_NUMERIC_SQL),
    "events_value_profile": (pf.events_value_profile, pf.EVENTS_VALUE_SQL),
    "lineitem_modes": (pf.lineitem_modes, pf.LINEITEM_MODES_SQL),
    "orders_categorical_profile": (pf.orders_categorical_profile, pf.ORDERS_CATEGORICAL_SQL),
    "part_categorical_profile": (pf.part_categorical_profile, pf.PART_CATEGORICAL_SQL),
    "lineitem_binary_profile": (pf.lineitem_binary_profile, pf.LINEITEM_BINARY_SQL),
    "document_effective_unique": (pf.document_effective_unique, pf.DOC_EFFECTIVE_SQL),
    "lineitem_histogram": (pf.lineitem_histogram, pf.LINEITEM_HISTOGRAM_SQL),
    "part_value_extremes": (pf.part_value_extremes, pf.PART_EXTREMES_SQL),
    "lineitem_value_overview": (pf.lineitem_value_overview, pf.LINEITEM_OVERVIEW_SQL),
    "customer_missingness": (pf.customer_missingness, pf.CUSTOMER_MISSINGNESS_SQL),
    "document_predictor_types": (sc.document_predictor_types, sc.PREDICTOR_TYPES_SQL),
    "document_associations": (sc.document_associations, sc.DOC_ASSOC_SQL),
    "document_associations_pvalues": (sc.document_associations_pvalues, inf.ASSOC_P_SQL),
    "lineitem_price_associations": (sc.lineitem_price_associations, sc.LINEITEM_PRICE_SQL),
    "document_decisions": (sc.document_decisions, sc.DOC_DECISIONS_SQL),
    "document_decision_summary": (sc.document_decision_summary, sc.DOC_DECISION_SUMMARY_SQL),
    "events_mann_whitney": (inf.events_mann_whitney, inf.EVENTS_MW_SQL),
    "document_chi_square": (inf.document_chi_square, inf.DOC_CHI_SQL),
    "planted_fdr": (inf.planted_fdr, inf.PLANTED_FDR_SQL),
    "planted_effect_bands": (inf.planted_effect_bands, inf.PLANTED_BANDS_SQL),
    "document_inferential_screen": (inf.document_inferential_screen, None),
    "document_screen_facts": (inf.document_screen_facts, inf.SCREEN_FACTS_SQL),
    "document_fisher": (inf.document_fisher, inf.FISHER_SQL),
    "document_task_metadata": (ck.document_task_metadata, ck.TASK_METADATA_SQL),
    "document_profiled_columns": (ck.document_profiled_columns, ck.PROFILED_COLUMNS_SQL),
    "document_frame_tables": (ck.document_frame_tables, ck.FRAME_TABLES_SQL),
    "customer_mode_fallback": (ck.customer_mode_fallback, ck.MODE_FALLBACK_SQL),
    "customer_imputation_invariants": (ck.customer_imputation_invariants, ck.IMPUTATION_INVARIANTS_SQL),
    "party_preview_rows": (ck.party_preview_rows, ck.PREVIEW_ROWS_SQL),
    "scored_metrics_values": (ck.scored_metrics_values, ck.METRICS_VALUES_SQL),
    "customer_simple_impute": (md.customer_simple_impute, md.CUSTOMER_IMPUTE_SQL),
    "document_model_frame": (md.document_model_frame, md.DOC_MODEL_FRAME_SQL),
    "document_frame_summary": (md.document_frame_summary, md.DOC_FRAME_SUMMARY_SQL),
    "document_split_counts": (md.document_split_counts, md.DOC_SPLIT_SQL),
    "document_fold_sizes": (md.document_fold_sizes, md.DOC_FOLDS_SQL),
    "scored_metrics": (md.scored_metrics, md.SCORED_METRICS_SQL),
    "scored_roc_points": (md.scored_roc_points, md.SCORED_ROC_SQL),
    "scored_pr_points": (md.scored_pr_points, md.SCORED_PR_SQL),
    "scored_confusion": (md.scored_confusion, md.SCORED_CONFUSION_SQL),
    "scored_calibration": (md.scored_calibration, md.SCORED_CALIBRATION_SQL),
    "scored_histogram": (md.scored_histogram, md.SCORED_HISTOGRAM_SQL),
    "scored_threshold_scan": (md.scored_threshold_scan, md.SCORED_SCAN_SQL),
    "document_logistic_run": (md.document_logistic_run, None),
    "document_predictive_metrics": (md.document_predictive_metrics, None),
    "document_search_audit": (md.document_search_audit, md.SEARCH_AUDIT_SQL),
    "document_saved_model_scores": (md.document_saved_model_scores, md.SAVED_SCORES_SQL),
    "document_predictive_bundle": (md.document_predictive_bundle, md.PREDICTIVE_BUNDLE_SQL),
    "document_model_comparison": (md.document_model_comparison, None),
    "document_top_features": (md.document_top_features, None),
    "customer_iterative_impute": (md.customer_iterative_impute, None),
    "document_approved_predictors": (sc.document_approved_predictors, sc.APPROVED_SQL),
    "document_report_bundle": (rp.document_report_bundle, ck.REPORT_BUNDLE_SQL),
    "events_janitor": (rp.events_janitor, rp.EVENTS_JANITOR_SQL),
    "scored_metrics_long": (rp.scored_metrics_long, None),
    "scored_pr_summary": (rp.scored_pr_summary, rp.PR_SUMMARY_SQL),
    "events_janitor_overview": (rp.events_janitor_overview, rp.EVENTS_OVERVIEW_SQL),
    "document_overview": (rp.document_overview, rp.DOCUMENT_OVERVIEW_SQL),
    "party_header_diff": (cl.party_header_diff, cl.PARTY_DIFF_SQL),
    "party_preview": (cl.party_preview, cl.PARTY_PREVIEW_SQL),
}

# DuckDB widens count_if / sums of counts to HUGEINT and returns BIGINT calendar
# parts; the oracle columns are cast to the widths the Spark queries declare.
_B, _I = "BIGINT", "INTEGER"
_CASTS = {
    "agreement_by_ship_day": {"n_match": _B},
    "calendar_parts": {"ts_hour": _I, "ts_year": _I},
    "events_stream_calendar": {"ts_hour": _I, "ts_year": _I},
    "customer_shape": {"null_cells": _B},
    "document_headline": {"n_positive": _B, "n_negative": _B},
    "orders_categorical_profile": {"n": _B},
    "part_categorical_profile": {"n": _B},
    "lineitem_binary_profile": {"n": _B},
    "document_effective_unique": {"effective_unique": _B},
    "part_value_extremes": {"rank": _I},
    "customer_missingness": {"n_missing": _B},
    "document_associations": {"n_used": _B, "analysis_excluded_n": _B, "predictor_missing_n": _B},
    "events_mann_whitney": {"n1": _B, "n0": _B, "n_values": _B},
    "document_chi_square": {"n": _B},
    "scored_metrics": {"tp": _B, "fp": _B, "tn": _B, "fn": _B},
    "scored_threshold_scan": {"tp": _B, "fp": _B, "tn": _B, "fn": _B},
    "events_janitor": {"ts_hour": _I},
}


def _cast(sql: str, casts: dict) -> str:
    rep = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in casts.items())
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _t"


# Operator ids each registered query exercises.
COVERS = {'agreement_by_ship_day': 'D1 D4 D5 D8 C1 C2 C3 C5 A21', 'agreement_match_rates': 'D1 D2', 'party_union': 'U1 P1 P2 P3 P4 P8 P12 P13', 'party_csv_ingest': 'S1 S2 U1 P1 P2', 'priority_clean_counts': 'P5 P6 P7 P11 P12', 'priority_schema_audit': 'P5 P6 P8', 'events_typed': 'P5 P8 P9 P10 P13 D9', 'events_rejected': 'P8 P9', 'calendar_parts': 'D3 D4 D5 D6 D7', 'events_stream_calendar': 'D3 D4 D5 D6 D7', 'customer_missing_flags': 'P14 P15', 'customer_shape': 'A1', 'document_dup_masks': 'K1 K2', 'document_dup_report': 'K3', 'document_dedupe': 'K4', 'conversation_encounters': 'K5', 'document_attrition': 'C1 C2 C4', 'document_cohort': 'C2 C3 C5 C6 C7 P15 P16 G1', 'document_headline': 'A22', 'document_target_counts': 'A21', 'lineitem_numeric_profile': 'A4 A5 A6 A7 A8', 'events_value_profile': 'A5 A7 A8', 'lineitem_modes': 'A6', 'orders_categorical_profile': 'A9 A10 A11 A12 A13 A14', 'part_categorical_profile': 'A10 A11 A12 A14', 'lineitem_binary_profile': 'A15 A16 A17', 'document_effective_unique': 'A18', 'lineitem_histogram': 'A19', 'part_value_extremes': 'A2', 'lineitem_value_overview': 'A2 D10', 'customer_missingness': 'A20', 'document_predictor_types': 'R1 R2', 'document_associations': 'C9 R4 T1 T2 T3 T4 T5 T6 T8', 'document_associations_pvalues': 'T7 T8', 'lineitem_price_associations': 'T1 T6', 'document_decisions': 'R5 R6 R7 R8', 'document_decision_summary': 'R9', 'events_mann_whitney': 'I4 I5 G1', 'document_chi_square': 'T3 I6 I8 I9', 'planted_fdr': 'I11', 'planted_effect_bands': 'I12 I13', 'document_inferential_screen': 'R12 I1 I2 I3 I4 I5 I6 I7 I8 I9 I10 I11 I12 I13 I14 I15 I16', 'document_screen_facts': 'I2 I3 I4 I5 I6 I7 I8 I9 I11 I12 I14 I15 I16', 'document_fisher': 'I7 I8', 'document_task_metadata': 'C7 R12', 'document_profiled_columns': 'C8 A4 A9 A16', 'document_frame_tables': 'M8', 'customer_mode_fallback': 'M5 M3', 'customer_imputation_invariants': 'M4', 'party_preview_rows': 'S5', 'scored_metrics_values': 'G9', 'customer_simple_impute': 'M2 M3', 'document_model_frame': 'M1 M4 M5 M6 M7 U2', 'document_frame_summary': 'M8', 'document_split_counts': 'L1', 'document_fold_sizes': 'L7 L8', 'scored_metrics': 'L14 L15 L17', 'scored_roc_points': 'G2 G1', 'scored_pr_points': 'G3', 'scored_confusion': 'G4', 'scored_calibration': 'G5', 'scored_histogram': 'G6', 'scored_threshold_scan': 'L11 L12', 'document_logistic_run': 'S10 R12 L1 L2 L3 L4 L7 L8 L10 L11 L14 L15 L16 L17 L18 L20', 'document_predictive_metrics': 'L5 L6 L13 L18 L20', 'document_search_audit': 'L4 L5 L6 L8 L9 L20', 'document_saved_model_scores': 'S10 L1 L2 L3', 'document_predictive_bundle': 'G2 G3 G4 G5 G6 G7 G8 G9 G10', 'document_model_comparison': 'L9 G8', 'document_top_features': 'L19 G7', 'customer_iterative_impute': 'M4', 'document_approved_predictors': 'C10 R3 R10 R11 I1', 'document_report_bundle': 'C8 S6 S7 S8 S9 G10', 'events_janitor': 'P17 K3 K4', 'scored_metrics_long': 'G9', 'scored_pr_summary': 'G3', 'events_janitor_overview': 'P17 A1 K5', 'document_overview': 'A3', 'party_header_diff': 'S2 S3 S4 U3', 'party_preview': 'S5'}

QUERIES = {k: v[0] for k, v in _ENTRIES.items()}
ORACLE_SQL = {k: (_cast(v[1], _CASTS[k]) if k in _CASTS else v[1]) for k, v in _ENTRIES.items() if v[1] is not None}
