"""Report texts in plain SQL over the marts: the same statement runs in Spark and in its twin.

A report names its mart, columns, filter, order and length; doubles are rounded before they are
sorted, and rows that tie in the report's order settle by the mart's key, so a report is the
same on every run. Spark runs sort and length as a distributed top-k.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from contrastry.operators.lookups import register_views
from contrastry.plans import gold_contrasts as gc
from contrastry.plans import gold_evidence as ge
from contrastry.plans import studies as st
from contrastry.plans import views as v

DIGITS = 6


@dataclass(frozen=True)
class Report:
    """``doubles`` are the columns to round; a leading minus in ``order`` sorts descending."""

    mart: str
    columns: str
    doubles: str = ""
    where: str = ""
    order: tuple[str, ...] = ()
    ties: str = "cancer_type, gene_symbol"
    limit: int | None = None

    def text(self) -> str:
        """The statement: what is kept, then its columns, then the order."""
        doubles = set(self.doubles.split())
        unknown = doubles - set(self.columns.split()) - {o.lstrip("-") for o in self.order}
        if unknown:
            raise ValueError(f"rounded but neither shown nor sorted by: {sorted(unknown)}")

        def shown(c: str) -> str:
            return f"round(m.{c}, {DIGITS})" if c in doubles else f"m.{c}"

        parts = [f"SELECT {', '.join(f'{shown(c)} AS {c}' for c in self.columns.split())} FROM {self.mart} m"]
        if self.where:
            parts.append(f"WHERE {self.where}")
        if self.order or self.limit is not None:
            by = [shown(o.lstrip("-")) + (" DESC NULLS LAST" if o.startswith("-") else " ASC NULLS LAST") for o in self.order]
            parts.append(f"ORDER BY {', '.join([*by, *(f'm.{t}' for t in self.ties.split(', '))])}")
        if self.limit is not None:
            parts.append(f"LIMIT {self.limit}")
        return " ".join(parts)


COHORT = "BUILDING"
FOLD_CHANGES = "log2_fc_tumor_vs_tcga_normal log2_fc_tumor_vs_gtex log2_fc_tcga_normal_vs_gtex"

REPORTS = {
    "sql_cohort_totals": Report(
        "cohort_totals", "tcga_project_count tcga_patient_count tcga_sample_count tcga_file_count gtex_expression_sample_count tcga_expression_row_count "
        "gtex_expression_row_count gene_count mutation_record_count"),
    "sql_top_overexpressed": Report(
        "contrast", "gene_symbol cancer_type median_tcga_tumor_expression median_gtex_normal_expression log2_fold_change sample_count_tumor sample_count_normal",
        "median_tcga_tumor_expression median_gtex_normal_expression log2_fold_change", f"cancer_type = '{COHORT}'", ("-log2_fold_change",), limit=20),
    "sql_priority_candidates": Report(
        "priority", "cancer_type gene_symbol priority_score priority_tier mutation_frequency abs_log2_fold_change evidence_count evidence_summary",
        "priority_score mutation_frequency abs_log2_fold_change", "", ("-priority_score", "-mutation_frequency"), limit=25),
    "sql_connected_nodes": Report(
        "metrics", "node_id node_label name total_degree in_degree out_degree weighted_degree edge_type_count degree_rank", "weighted_degree", "",
        ("-total_degree", "-weighted_degree"), "node_id", 25),
    "sql_confident_evidence": Report(
        "confidence", "cancer_type gene_symbol priority_score overall_confidence confidence_tier mutation_confidence expression_confidence batch_sensitivity_confidence "
        "batch_concordance graph_confidence traceability_confidence batch_effect_risk caveat_summary",
        "priority_score overall_confidence mutation_confidence expression_confidence batch_sensitivity_confidence graph_confidence traceability_confidence",
        "confidence_tier IN ('high', 'moderate') AND batch_concordance = 'concordant'", ("-overall_confidence", "-priority_score"), limit=50),
    "sql_rank_shifts": Report(
        "rank_shifts", "cancer_type gene_symbol percentile_delta robust_z_delta support_tier sensitivity_direction batch_method", "percentile_delta robust_z_delta percentile_shift robust_z_shift",
        "support_tier = 'high'", ("-percentile_shift", "-robust_z_shift"), limit=50),
    "sql_stable_candidates": Report(
        "bootstrap", "cancer_type gene_symbol candidate_priority_rank candidate_selection_reason bootstrap_stability_score bootstrap_stability_tier reference_concordance_rate "
        "opposite_direction_rate tcga_median_rank gtex_median_rank",
        "bootstrap_stability_score reference_concordance_rate opposite_direction_rate tcga_median_rank gtex_median_rank", "evidence_confidence_tier = 'high'",
        ("-bootstrap_stability_score",), limit=50),
    "sql_corroborated_genes": Report(
        "validation", "cancer_type gene_symbol native_log2_fold_change recount3_log2_fold_change effect_delta direction_agreement validation_score validation_tier top_k_overlap",
        "native_log2_fold_change recount3_log2_fold_change effect_delta validation_score", "direction_agreement = 'concordant'", ("-validation_score", "effect_delta"), limit=50),
    "sql_pathway_links": Report(
        "pathway_links", "cancer_type pathway_name enrichment_score evidence_source", "enrichment_score", "", ("cancer_type", "-enrichment_score"), "pathway_name, evidence_source", 50),
    "sql_reference_methods": Report(
        "comparison", "cancer_type method_a method_b top_k top_k_jaccard universe_direction_concordance regulated_direction_concordance spearman_abs_effect agreement_tier",
        "top_k_jaccard universe_direction_concordance regulated_direction_concordance spearman_abs_effect", "", ("cancer_type", "-top_k_jaccard"), "method_a, method_b, top_k"),
    "sql_component_ablation": Report(
        "ablation", "cancer_type ablation_scenario top_k top_k_jaccard spearman_consensus_score fixed_threshold_retention_rate sensitivity_tier",
        "top_k_jaccard spearman_consensus_score fixed_threshold_retention_rate", "", ("cancer_type", "ablation_scenario"), "top_k"),
}

# Views that a report needs beyond the marts: (the marts they read, their SQL in both engines).
DERIVED = {
    "rank_shifts": (("batch",), "SELECT *, abs(percentile_delta) AS percentile_shift, abs(robust_z_delta) AS robust_z_shift FROM batch"),
    "pathway_links": (("edges", "nodes"), """SELECT e.target_node_id AS cancer_type, n.name AS pathway_name, e.weight AS enrichment_score, e.evidence_source
        FROM edges e JOIN nodes n ON n.node_id = e.source_node_id WHERE e.edge_type = 'ENRICHED_IN_CANCER'"""),
}
v.SQL_VIEWS.update(DERIVED)
v.SQL_VIEWS["cohort_totals"] = ((), ge.SQL["cohort_summary"])

MARTS = {
    "cohort_totals": ge.summary, "contrast": gc.contrast, "priority": ge.priority, "metrics": ge.metrics, "confidence": ge.confidence, "batch": gc.batch,
    "bootstrap": st.bootstrap, "validation": gc.validation, "edges": ge.edges, "nodes": ge.nodes, "comparison": st.comparison, "ablation": st.ablation,
}


def run_report(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    report = REPORTS[name]
    needed, derived = DERIVED.get(report.mart, ((report.mart,), None))
    register_views({mart: MARTS[mart](spark, sf_dir) for mart in needed})
    if derived:
        register_views({report.mart: spark.sql(derived)})
    return spark.sql(report.text())


def _query(name: str):
    return lambda s, d: run_report(s, d, name)


QUERIES = {name: _query(name) for name in REPORTS}
SQL = {name: v.sql(report.text(), report.mart) for name, report in REPORTS.items()}
