"""Data-quality rules as aggregates: one result row per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.functions.ordered import mid_rank
from contrastry.operators.graph import is_individual
from contrastry.operators.scores import is_public_origin
from contrastry.session import materialize
from contrastry.sources.listing import listed_files, with_digests

RESULT = ["check_name", "status", "failed_rows"]


@dataclass(frozen=True)
class Rule:
    """``violation`` is a SQL predicate true for a bad row; columns it needs are listed."""

    name: str
    table: str
    violation: str
    needs: tuple[str, ...] = field(default=())


def _blank(c: str) -> str:
    return f"trim(coalesce(cast({c} as string), '')) = ''"


def _unit(*columns: str) -> str:
    return " or ".join(f"not ({c} between 0.0 and 1.0)" for c in columns)


def _label(c: str, *values: str) -> str:
    return f"{c} not in ({', '.join(repr(v) for v in values)})"


# Row rules of the conformed tables (null, access, sign, unit, provenance, consequence and profile rules).
SILVER_RULES = (
    Rule("silver_projects_null_project_id", "projects", _blank("project_id"), ("project_id",)),
    Rule("silver_manifest_access_open_only", "manifest", "access <> 'open'", ("access",)),
    Rule("silver_manifest_md5_present", "manifest", _blank("md5sum"), ("md5sum",)),
    Rule("silver_expression_gtex_null_gene_id", "reference", _blank("gene_id"), ("gene_id",)),
    Rule("silver_expression_tcga_null_gene_id", "tumour", _blank("gene_id"), ("gene_id",)),
    Rule("silver_mutations_null_gene_symbol", "mutations", _blank("gene_symbol"), ("gene_symbol",)),
    Rule("silver_expression_gtex_non_negative", "reference", "try_cast(expression_value as double) < 0", ("expression_value",)),
    Rule("silver_expression_tcga_non_negative", "tumour", "try_cast(expression_value as double) < 0", ("expression_value",)),
    Rule("silver_expression_recount3_non_negative", "reprocessed", "try_cast(expression_value as double) < 0", ("expression_value",)),
    Rule("silver_expression_tcga_unit_supported", "tumour", _label("upper(expression_unit)", "TPM", "FPKM", "COUNT"), ("expression_unit",)),
    Rule("silver_expression_gtex_unit_supported", "reference", _label("upper(expression_unit)", "TPM"), ("expression_unit",)),
    Rule("silver_expression_recount3_source_supported", "reprocessed", _label("source", "TCGA", "GTEx"), ("source",)),
    Rule(
        "silver_expression_tcga_workflow_unit_compatibility", "tumour",
        "((lower(pipeline_workflow) like '%htseq - counts%' or lower(pipeline_workflow) like '%htseq\\_counts%') and upper(coalesce(expression_unit, '')) <> 'COUNT') "
        "or (lower(pipeline_workflow) like '%fpkm%' and upper(coalesce(expression_unit, '')) <> 'FPKM')",
        ("pipeline_workflow", "expression_unit"),
    ),
    Rule("silver_mutations_start_position_valid_integer", "mutations", "try_cast(start_position as bigint) is null", ("start_position",)),
    Rule("silver_mutations_end_position_valid_integer", "mutations", "try_cast(end_position as bigint) is null", ("end_position",)),
    Rule(
        "silver_expression_gtex_public_provenance", "reference",
        "lower(data_origin) like '%stub%' or lower(data_origin) like '%placeholder%' or lower(data_origin) like '%demo%'", ("data_origin",),
    ),
    Rule(
        "silver_mutation_consequence_semantics_valid", "mutations",
        _label("consequence_group", "protein_altering", "synonymous", "non_coding_or_regulatory", "unclassified")
        + " or is_protein_altering <> (consequence_group = 'protein_altering')",
        ("consequence_group", "is_protein_altering"),
    ),
    Rule(
        "silver_mutation_profile_rows_valid", "profile",
        f"{_blank('project_id')} or {_blank('sample_id')} or {_blank('file_id')} or profile_status <> 'downloaded'",
        ("project_id", "sample_id", "file_id", "profile_status"),
    ),
)

# Value contracts of the published marts.
CONTRACT_RULES = (
    Rule("gold_mutation_frequency_semantics_valid", "mutation_frequency",
         _unit("mutation_frequency") + " or mutated_sample_count > total_profiled_sample_count or protein_altering_event_count > all_somatic_event_count "
         "or upper(top_variant_classification) = 'SILENT' or mutation_scope <> 'protein_altering_only'", ("mutation_frequency",)),
    Rule("gold_mutation_functional_evidence_semantics_valid", "functional",
         _unit("recurrent_locus_sample_fraction") + " or protein_altering_mutated_sample_count > total_profiled_sample_count "
         "or samples_with_recurrent_locus_count > protein_altering_mutated_sample_count or max_locus_sample_count > protein_altering_mutated_sample_count "
         "or recurrence_threshold_samples < 2 or known_assembly_event_count + unknown_assembly_event_count < protein_altering_mutated_sample_count "
         "or driver_evidence_scope <> 'consequence_and_exact_locus_recurrence' or driver_classification <> 'not_assessed'", ("recurrent_locus_sample_fraction",)),
    Rule("gold_mutation_transcript_evidence_semantics_valid", "transcript",
         _unit("sample_fraction") + " or distinct_sample_count > profiled_sample_count or hgvsc_annotation_event_count > event_count "
         "or hgvsp_annotation_event_count > event_count or all_effects_annotation_event_count > event_count "
         "or annotation_scope <> 'gdc_maf_reported_transcript' or impact_interpretation <> 'source_vep_category_not_driver_classification'", ("sample_fraction",)),
    Rule("gold_batch_effect_sensitivity_values_supported", "batch",
         _label("support_tier", "high", "moderate", "limited") + " or " + _label("sensitivity_direction", "rank_up", "rank_down", "stable"), ("support_tier", "sensitivity_direction")),
    Rule("gold_evidence_confidence_batch_values_supported", "confidence",
         _unit("batch_sensitivity_confidence") + " or " + _label("batch_concordance", "concordant", "inconclusive", "discordant", "unavailable", "not_applicable")
         + " or " + _label("batch_effect_risk", "high", "elevated", "not_applicable"), ("batch_sensitivity_confidence",)),
    Rule("gold_reference_triangulation_values_supported", "triangulation",
         _label("reference_concordance", "concordant_up", "concordant_down", "concordant_stable", "reference_sensitive", "discordant")
         + " or " + _label("tcga_normal_support_tier", "high", "moderate", "limited") + " or " + _unit("reference_stability_score"), ("reference_concordance",)),
    Rule("gold_candidate_bootstrap_stability_values_supported", "bootstrap",
         "bootstrap_iterations < 20 or ranking_universe_gene_count < 1 or " + _unit("reference_concordance_rate", "opposite_direction_rate", "bootstrap_stability_score")
         + " or " + _label("bootstrap_stability_tier", "high", "moderate", "limited", "unstable"), ("bootstrap_iterations",)),
    Rule("gold_external_expression_validation_values_supported", "validation",
         _label("direction_agreement", "concordant", "inconclusive", "discordant") + " or " + _unit("validation_score", "top_k_jaccard_by_cancer")
         + " or " + _label("validation_tier", "high", "moderate", "limited", "discordant") + " or evidence_scope not like '%not_independent_validation%' or "
         + _label("sample_overlap_status", "observed_overlap", "no_observed_overlap", "not_audited") + " or tcga_sample_overlap_count < 0 or gtex_sample_overlap_count < 0", ("validation_score",)),
    Rule("gold_expression_statistical_support_values_supported", "statistics",
         _unit("native_fdr_q_value", "recount3_fdr_q_value", "statistical_support_score") + " or not (native_rank_biserial between -1.0 and 1.0) or not (recount3_rank_biserial between -1.0 and 1.0) or "
         + _label("statistical_support_tier", "replicated_fdr", "recount3_fdr_supported", "native_only_fdr", "limited", "discordant")
         + " or (statistical_support_tier = 'discordant' and statistical_support_score <> 0.0)", ("statistical_support_score",)),
    Rule("gold_paired_tcga_expression_support_values_supported", "paired",
         "matched_case_count < 10 or " + _unit("paired_fdr_q_value", "paired_support_score") + " or not (paired_rank_biserial between -1.0 and 1.0) or "
         + _label("paired_support_tier", "paired_replicated", "paired_internal_fdr", "limited", "paired_discordant")
         + " or (paired_support_tier = 'paired_discordant' and paired_support_score <> 0.0)", ("paired_support_score",)),
    Rule("gold_pathway_enrichment_values_supported", "enrichment",
         "background_gene_count <= 0 or candidate_gene_count <= 0 or pathway_gene_count <= 0 or overlap_gene_count <= 0 or overlap_gene_count > candidate_gene_count "
         "or overlap_gene_count > pathway_gene_count or " + _unit("p_value", "fdr_q_value", "enrichment_score") + " or " + _label("enrichment_tier", "fdr_enriched", "nominal", "limited"), ("enrichment_tier",)),
    Rule("gold_reference_method_comparison_values_supported", "comparison",
         "common_gene_count <= 0 or top_k <= 0 or " + _unit("top_k_jaccard", "regulated_direction_concordance") + " or not (spearman_abs_effect between -1.0 and 1.0) or "
         + _label("agreement_tier", "high", "moderate", "limited"), ("agreement_tier",)),
    Rule("gold_consensus_ablation_stability_values_supported", "ablation",
         "common_gene_count <= 0 or top_k <= 0 or " + _unit("top_k_jaccard", "fixed_threshold_retention_rate") + " or not (spearman_consensus_score between -1.0 and 1.0) or "
         + _label("sensitivity_tier", "robust", "moderate", "sensitive"), ("sensitivity_tier",)),
)

# Columns every table must offer: (check prefix, table, columns).
REQUIRED_COLUMNS = (
    ("silver_projects", "projects", "project_id primary_site disease_type"),
    ("silver_samples", "samples", "project_id case_id sample_id sample_type"),
    ("silver_expression_tcga", "tumour", "project_id case_id sample_id gene_id gene_symbol expression_value expression_unit"),
    ("silver_expression_recount3", "reprocessed", "source project_id sample_id sample_type tissue_site gene_id gene_symbol expression_value expression_unit external_annotation"),
    ("silver_mutations", "mutations", "project_id case_id sample_id source_sample_id gene_symbol reference_assembly variant_classification consequence_group is_protein_altering "
     "start_position end_position transcript_id hgvsc hgvsp vep_impact vep_consequence all_effects"),
    ("silver_mutation_profile", "profile", "project_id sample_id file_id file_name data_origin profile_status"),
    ("gold_mutation_frequency", "mutation_frequency", "gene_symbol cancer_type mutated_sample_count total_profiled_sample_count mutation_frequency protein_altering_event_count "
     "all_somatic_event_count synonymous_event_count mutation_scope"),
    ("gold_mutation_functional_evidence", "functional", "gene_symbol cancer_type total_profiled_sample_count protein_altering_mutated_sample_count recurrent_locus_count "
     "recurrent_locus_sample_fraction recurrence_threshold_samples driver_evidence_scope driver_classification"),
    ("gold_mutation_transcript_evidence", "transcript", "cancer_type gene_symbol transcript_id vep_consequence vep_impact variant_classification profiled_sample_count "
     "distinct_sample_count event_count sample_fraction annotation_scope impact_interpretation"),
    ("gold_batch_effect_sensitivity", "batch", "gene_symbol cancer_type percentile_delta robust_z_delta support_tier sensitivity_direction"),
    ("gold_evidence_confidence", "confidence", "cancer_type gene_symbol overall_confidence batch_sensitivity_confidence batch_concordance batch_effect_risk"),
    ("gold_reference_triangulation", "triangulation", "cancer_type gene_symbol sample_count_tcga_normal reference_concordance tcga_normal_support_tier reference_stability_score"),
    ("gold_candidate_bootstrap_stability", "bootstrap", "cancer_type gene_symbol bootstrap_iterations ranking_universe_gene_count reference_concordance_rate "
     "opposite_direction_rate bootstrap_stability_score bootstrap_stability_tier"),
    ("gold_external_expression_validation", "validation", "cancer_type gene_symbol direction_agreement validation_score validation_tier top_k_jaccard_by_cancer evidence_scope sample_overlap_status"),
    ("gold_expression_statistical_support", "statistics", "cancer_type gene_symbol native_fdr_q_value recount3_fdr_q_value native_rank_biserial recount3_rank_biserial "
     "statistical_support_score statistical_support_tier"),
    ("gold_paired_tcga_expression_support", "paired", "cancer_type gene_symbol matched_case_count paired_fdr_q_value paired_rank_biserial paired_support_score paired_support_tier"),
    ("gold_pathway_enrichment", "enrichment", "cancer_type candidate_set pathway_id pathway_name background_gene_count candidate_gene_count pathway_gene_count overlap_gene_count "
     "p_value fdr_q_value enrichment_score enrichment_tier"),
    ("gold_reference_method_comparison", "comparison", "cancer_type method_a method_b common_gene_count top_k top_k_jaccard regulated_direction_concordance spearman_abs_effect agreement_tier"),
    ("gold_consensus_ablation_stability", "ablation", "cancer_type ablation_scenario common_gene_count top_k top_k_jaccard spearman_consensus_score fixed_threshold_retention_rate sensitivity_tier"),
    ("gold_graph_nodes", "nodes", "node_id node_label name"),
    ("gold_graph_edges", "edges", "edge_id source_node_id target_node_id edge_type"),
)


def graded(counts: DataFrame, *, otherwise: str = "failed") -> DataFrame:
    """(check_name, failed_rows) with a status."""
    return counts.select("check_name", F.when(F.col("failed_rows") == 0, "passed").otherwise(otherwise).alias("status"), F.col("failed_rows").cast("long").alias("failed_rows"))


def row_rules(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Rules on the same table share one aggregation over it; absent columns count as no violation."""
    out = None
    for table in dict.fromkeys(r.table for r in rules):
        if table not in tables:
            continue
        df = tables[table]
        mine = [r for r in rules if r.table == table]
        aggs = [
            (F.count_if(F.expr(r.violation)) if set(r.needs) <= set(df.columns) else F.lit(0).cast("long")).alias(r.name) for r in mine
        ]
        counts = df.agg(*aggs).select(F.explode(F.create_map(*[x for r in mine for x in (F.lit(r.name), F.col(r.name))])).alias("check_name", "failed_rows"))
        out = counts if out is None else out.unionByName(counts)
    return graded(out)


def schema_presence(spark: SparkSession, tables: Mapping[str, DataFrame], required=REQUIRED_COLUMNS) -> DataFrame:
    """Missing columns per table; a check of schemas only, no data is read."""
    rows = [
        (f"{name}_schema_columns_present", len(set(columns.split()) - set(tables[table].columns))) for name, table, columns in required if table in tables
    ]
    return graded(spark.createDataFrame(rows, "check_name string, failed_rows long"))


def _count_as(df: DataFrame, name: str, count: Column) -> DataFrame:
    return df.agg(count.alias("failed_rows")).select(F.lit(name).alias("check_name"), "failed_rows")


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows beyond the first of each key, by one aggregation spread over the keys."""
    if set(keys) - set(df.columns):
        missing = len(set(keys) - set(df.columns))
        return graded(_count_as(df.limit(0), name, F.lit(missing)))
    return graded(_count_as(df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra")), name, F.coalesce(F.sum("extra"), F.lit(0))))


def duplicate_known_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Known identifiers that occur more than once."""
    known = df.where((F.trim(F.col(column)) != "") & (F.lower(F.col(column)) != "unknown"))
    return graded(_count_as(known.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name, F.count(F.lit(1))))


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str], name: str, *, distinct: bool = False) -> DataFrame:
    """Child rows (or distinct keys) without a parent."""
    rows = child.select(*keys).distinct() if distinct else child
    return graded(_count_as(rows.join(parent.select(*keys).distinct(), list(keys), "left_anti"), name, F.count(F.lit(1))))


def known_cases(mutations: DataFrame) -> DataFrame:
    return mutations.where((F.trim("case_id") != "") & (F.lower("case_id") != "unknown"))


def dangling_edges(nodes: DataFrame, edges: DataFrame, name: str = "gold_graph_edges_node_fk_integrity") -> DataFrame:
    """Edges (distinct ids) of which an end is no node; an edge stays one row."""
    # written, so that its size is known when the joins are planned: the edges stay where they are if it is small
    ids = materialize(nodes.select("node_id").distinct(), "ids")
    known = edges.select("edge_id", "source_node_id", "target_node_id")
    for end in ("source_node_id", "target_node_id"):
        known = known.join(ids.select(F.col("node_id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    bad = known.where(F.col("_source_node_id").isNull() | F.col("_target_node_id").isNull()).select("edge_id").distinct()
    return graded(_count_as(bad, name, F.count(F.lit(1))))


def minimum_support(df: DataFrame, group: str, sample: str, name: str, *, threshold: int = 30) -> DataFrame:
    """Smallest number of distinct samples over the groups; below the threshold is a warning."""
    per = df.groupBy(group).agg(F.count_distinct(sample).alias("n"))
    return per.agg(F.coalesce(F.min("n"), F.lit(0)).alias("metric_value")).select(
        F.lit(name).alias("check_name"), F.when(F.col("metric_value") >= threshold, "passed").otherwise("warning").alias("status"),
        F.when(F.col("metric_value") >= threshold, 0).otherwise(1).cast("long").alias("failed_rows"),
        F.lit("min_samples").alias("metric_name"), F.col("metric_value").cast("double").alias("metric_value"), F.lit(float(threshold)).alias("threshold"),
    )


def minimum_column(df: DataFrame, column: str, name: str, *, threshold: int = 30) -> DataFrame:
    """Smallest value of a mart column; an empty mart passes."""
    low = df.agg(F.min(column).alias("metric_value"))
    good = F.col("metric_value").isNull() | (F.col("metric_value") >= threshold)
    return low.select(
        F.lit(name).alias("check_name"), F.when(good, "passed").otherwise("warning").alias("status"), F.when(good, 0).otherwise(1).cast("long").alias("failed_rows"),
        F.lit("min_samples").alias("metric_name"), F.col("metric_value").cast("double").alias("metric_value"), F.lit(float(threshold)).alias("threshold"),
    )


def non_empty(tables: Mapping[str, DataFrame], name: str = "live_mode_non_zero_row_sanity") -> DataFrame:
    """How many of the core tables are empty (each scan stops at its first row)."""
    out = None
    for df in tables.values():
        flag = df.limit(1).agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("empty"))
        out = flag if out is None else out.unionByName(flag)
    return graded(_count_as(out, name, F.sum("empty")))


def mapping_rate(df: DataFrame, column: str, *, threshold: float = 0.98, name: str = "gene_mapping_rate") -> DataFrame:
    rate = df.agg(F.coalesce(F.avg((F.coalesce(F.col(column), F.lit("")) != "").cast("double")), F.lit(0.0)).alias("metric_value"))
    return rate.select(
        F.lit(name).alias("check_name"), F.when(F.col("metric_value") >= threshold, "passed").otherwise("warning").alias("status"),
        F.lit("mapping_rate").alias("metric_name"), "metric_value", F.lit(threshold).alias("threshold"),
    )


def file_integrity(manifest: DataFrame, listing: DataFrame, *, selected: DataFrame | None = None, partial: bool = False) -> DataFrame:
    """Open manifest files that are absent or whose checksum differs.

    ``listing`` is (file_name, md5), as ``file_listing`` gives it.
    """
    wanted = manifest.where((F.lower("access") == "open") & (F.trim("file_name") != ""))
    if selected is not None:
        wanted = wanted.join(selected.select("file_name").distinct(), "file_name", "left_semi")
    found = listing.groupBy("file_name").agg(F.min("md5").alias("observed"))
    joined = wanted.join(found, "file_name", "left")
    counts = joined.agg(
        F.count_if(F.col("observed").isNull()).alias("bronze_tcga_download_file_presence"),
        F.count_if(F.col("observed").isNotNull() & (F.col("md5sum") != "") & (F.col("observed") != F.col("md5sum"))).alias("bronze_tcga_download_checksum_match"),
    )
    long = counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))])).alias("check_name", "failed_rows"))
    return graded(long, otherwise="warning" if partial else "failed")


def file_listing(spark: SparkSession, path: str, *, name: str = r"([^/]+)$") -> DataFrame:
    """(file_name, md5) of the files under a folder, read in pieces."""
    return with_digests(listed_files(spark, path, name=name)).select("file_name", "md5")


def roll_up(results: DataFrame) -> DataFrame:
    """Overall status: failed beats warning beats passed."""
    worst = F.max(F.when(F.col("status") == "failed", 2).when(F.col("status") == "warning", 1).otherwise(0))
    return results.agg(
        F.when(worst == 2, "failed").when(worst == 1, "passed_with_warnings").otherwise("passed").alias("status"), F.count(F.lit(1)).alias("checks")
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def midrank_violations(batch: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """Published percentiles that differ from percentiles recomputed from the medians."""
    keys = ["cancer_type"]
    ranked = mid_rank(batch, keys, "tumor_log2_median", "_rt", total="_n")
    ranked = mid_rank(ranked, keys, "normal_log2_median", "_rn")

    def pct(rank: str) -> Column:
        return F.when(F.col("_n") > 1, (F.col(rank) - 1.0) / (F.col("_n") - 1.0)).otherwise(0.5)

    off = (F.abs(pct("_rt") - F.col("tumor_expression_percentile")) > tolerance) | (F.abs(pct("_rn") - F.col("normal_expression_percentile")) > tolerance)
    return ranked.where(off).select("cancer_type", "gene_symbol")


def multiset_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity."""
    second = second.select(*first.columns)
    return first.exceptAll(second).withColumn("side", F.lit("first")).unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))


def declared_tests(tables: Mapping[str, DataFrame], declarations: Sequence[tuple]) -> DataFrame:
    """not_null / unique / accepted_values rules declared per (table, column); one scan for each table.

    A row becomes one entry per declaration: its value where the values must be unique, a failure
    or nothing else. Entries are counted by value with map-side combining, then by declaration,
    so a frequent value is one cell. NULLs are neither repeated nor outside a list of values.
    """
    out = None
    for table in dict.fromkeys(d[0] for d in declarations):
        entries, names = [], []
        for _, column, kind, *values in [d for d in declarations if d[0] == table]:
            if kind not in ("unique", "not_null", "accepted_values"):
                raise ValueError(f"unknown test {kind}")
            c = F.col(column)
            failed = c.isNull() if kind == "not_null" else ~c.isin(*values[0]) if kind == "accepted_values" else F.lit(False)
            value = c.cast("string") if kind == "unique" else F.lit(None).cast("string")
            names.append(f"{table}.{column}.{kind}")
            entries.append(F.struct(F.lit(names[-1]).alias("check_name"), value.alias("value"), F.coalesce(failed, F.lit(False)).alias("failed")))
        cells = tables[table].select(F.explode(F.array(*entries)).alias("e")).select("e.*").groupBy("check_name", "value").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
        found = cells.groupBy("check_name").agg(F.sum(F.col("failed") + F.when(F.col("value").isNotNull() & (F.col("n") > 1), 1).otherwise(0)).alias("failed_rows"))
        declared = tables[table].sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("check_name"))  # a table without rows passes
        counts = declared.join(found, "check_name", "left").select("check_name", F.coalesce("failed_rows", F.lit(0)).alias("failed_rows"))
        out = counts if out is None else out.unionByName(counts)
    return graded(out)


def row_minimums(tables: Mapping[str, DataFrame], minimum: int = 1) -> DataFrame:
    """Row counts against a minimum, one row per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("check_name"), "row_count", (F.col("row_count") >= minimum).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def stub_rows(df: DataFrame) -> DataFrame:
    """Rows of stub, placeholder or demo origin (strict mode allows none)."""
    origin = F.lower(F.coalesce(F.col("data_origin").cast("string"), F.lit("")))
    return df.agg(F.count_if(origin.rlike("stub|placeholder|demo")).alias("stub_like_rows"), F.count(F.lit(1)).alias("row_count"), F.count_if(is_public_origin(F.col("data_origin"))).alias("public_rows"))


def individual_leaks(nodes: DataFrame, edges: DataFrame, *, repeated: bool = False) -> DataFrame:
    """Individual nodes or edges in a graph meant for publication; with ``repeated`` a node or an edge that
    has several rows counts once."""
    found_nodes = nodes.where(F.col("node_label").isin("Patient", "Sample") | is_individual("node_id")).select("node_id", "node_label")
    found_edges = edges.where(is_individual("source_node_id") | is_individual("target_node_id")).select("edge_id")
    bad_nodes, bad_edges = ((df.distinct() if repeated else df).agg(F.count(F.lit(1))).scalar() for df in (found_nodes, found_edges))
    return nodes.sparkSession.range(1).select(bad_nodes.alias("disallowed_nodes"), bad_edges.alias("disallowed_edges"))
