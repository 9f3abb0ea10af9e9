"""Parameterised read queries: filter, multi-key sort, limit, and the total match count.

Each mart has a specification; predicates and the needed columns reach the Parquet
reader, and sort plus limit runs as a distributed top-k.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastry.functions.ordered import group_quantiles


@dataclass(frozen=True)
class Lookup:
    """``equal`` columns match exactly, ``at_least``/``at_most`` bound, ``like`` finds a literal substring."""

    order: tuple[str, ...]
    equal: tuple[str, ...] = ("cancer_type",)
    like: tuple[str, ...] = ("gene_symbol",)
    at_least: tuple[str, ...] = ()
    at_most: tuple[str, ...] = ()
    absolute: tuple[str, ...] = ()


# Order: a leading minus sorts descending; columns in ``absolute`` sort and bound by magnitude.
LOOKUPS = {
    "tumour_vs_normal": Lookup(("-log2_fold_change",), equal=("cancer_type", "gene_symbol"), like=()),
    "mutation_frequency": Lookup(("-mutation_frequency",), equal=("cancer_type", "gene_symbol")),
    "candidate_priority": Lookup(
        ("-priority_score", "-evidence_count", "-mutation_frequency", "-abs_log2_fold_change"), equal=("cancer_type", "priority_tier"), at_least=("priority_score",)),
    "evidence_confidence": Lookup(
        ("-overall_confidence", "-priority_score"), equal=("cancer_type", "confidence_tier", "batch_concordance"), at_least=("overall_confidence",)),
    "batch_sensitivity": Lookup(
        ("-percentile_delta", "-robust_z_delta", "-sample_count_tumor", "-sample_count_normal"), equal=("cancer_type", "support_tier", "sensitivity_direction"),
        at_least=("percentile_delta",), absolute=("percentile_delta", "robust_z_delta")),
    "reference_triangulation": Lookup(
        ("-reference_stability_score", "reference_effect_delta"), equal=("cancer_type", "reference_concordance", "tcga_normal_support_tier"), at_least=("reference_stability_score",)),
    "bootstrap_stability": Lookup(
        ("-bootstrap_stability_score", "-priority_score"), equal=("cancer_type", "bootstrap_stability_tier"), at_least=("bootstrap_stability_score",)),
    "external_validation": Lookup(("-validation_score", "effect_delta"), equal=("cancer_type", "validation_tier", "direction_agreement"), at_least=("validation_score",)),
    "consensus_candidates": Lookup(
        ("-consensus_score", "-evidence_completeness"), equal=("cancer_type", "consensus_decision", "publication_tier"), at_least=("consensus_score",)),
    "expression_statistics": Lookup(
        ("-statistical_support_score", "recount3_fdr_q_value"), equal=("cancer_type", "statistical_support_tier"), at_least=("statistical_support_score",), at_most=("recount3_fdr_q_value",)),
    "paired_expression": Lookup(
        ("-paired_support_score", "paired_fdr_q_value"), equal=("cancer_type", "paired_support_tier"), at_least=("paired_support_score",), at_most=("paired_fdr_q_value",)),
    "pathway_enrichment": Lookup(
        ("-enrichment_score", "fdr_q_value"), equal=("cancer_type", "candidate_set", "enrichment_tier"), like=("pathway_name", "pathway_id"), at_least=("overlap_gene_count",),
        at_most=("fdr_q_value",)),
}


def _size(spec: Lookup, name: str) -> Column:
    return F.abs(name) if name in spec.absolute else F.col(name)


def matching(df: DataFrame, spec: Lookup, *, text: str | None = None, regex: bool = False, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """Rows that meet every given filter; unknown filter names are refused."""
    for given, known in ((equal, spec.equal), (at_least, spec.at_least), (at_most, spec.at_most)):
        if set(given or {}) - set(known):
            raise ValueError(f"unsupported filter: {sorted(set(given) - set(known))}")
    out = df
    for name, value in (equal or {}).items():
        out = out.where(F.col(name) == value)
    if text:
        hit = F.lit(False)
        for c in spec.like:
            upper = F.upper(F.col(c).cast("string"))
            hit = hit | (upper.rlike(text.upper()) if regex else upper.contains(text.upper()))
        out = out.where(hit)
    for name, value in (at_least or {}).items():
        out = out.where(_size(spec, name) >= value)
    for name, value in (at_most or {}).items():
        out = out.where(F.col(name) <= value)
    return out


def lookup(df: DataFrame, name: str, *, limit: int = 50, ties: tuple[str, ...] = ("cancer_type", "gene_symbol"), **filters) -> DataFrame:
    """The first ``limit`` matching rows in the mart's order; ties settle by key."""
    spec = LOOKUPS[name]
    order = [_size(spec, o.lstrip("-")).desc() if o.startswith("-") else _size(spec, o).asc() for o in spec.order]
    return matching(df, spec, **filters).orderBy(*order, *ties).limit(max(limit, 0))


def total_matching(df: DataFrame, name: str, **filters) -> DataFrame:
    return matching(df, LOOKUPS[name], **filters).agg(F.count(F.lit(1)).alias("total_matching_rows"))


def register_views(tables: dict[str, DataFrame]) -> None:
    """Offer tables to ``spark.sql`` under their mart names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def project_list(projects: DataFrame) -> DataFrame:
    return projects.select("project_id", "primary_site", "disease_type").distinct()


def project_samples(samples: DataFrame, project: str) -> DataFrame:
    """Distinct samples of a project and the sample types seen."""
    return samples.where(F.col("project_id") == project).groupBy("project_id").agg(
        F.count_distinct("sample_id").alias("sample_count"), F.array_join(F.array_sort(F.collect_set("sample_type")), ",").alias("sample_types")
    )


def gene_search(tables: list[DataFrame], text: str, *, limit: int = 20) -> DataFrame:
    """Distinct (id, symbol) of several tables with a substring in either."""
    out = None
    for df in tables:
        one = df.select(F.col("gene_id").cast("string"), F.col("gene_symbol").cast("string"))
        out = one if out is None else out.unionByName(one)
    term = text.upper()
    return out.where(F.upper("gene_symbol").contains(term) | F.upper("gene_id").contains(term)).distinct().orderBy("gene_symbol", "gene_id").limit(limit)


def expression_by_gene(tumour: DataFrame, reference: DataFrame, gene: str) -> DataFrame:
    """Median, mean and samples of one gene per project and per tissue."""
    hit = F.upper(F.col("gene_symbol").cast("string")) == gene.upper()
    rows = tumour.where(hit).select("project_id", F.lit(None).cast("string").alias("tissue_site"), "expression_value", "sample_id").unionByName(
        reference.where(hit).select(F.lit(None).cast("string").alias("project_id"), "tissue_site", "expression_value", F.col("gtex_sample_id").alias("sample_id")))
    return gene_measurements(rows)


def gene_measurements(rows: DataFrame) -> DataFrame:
    """Median, mean and samples per project (tumour rows) and per tissue (reference rows) of rows already chosen."""
    rows = rows.withColumns({"source": F.when(F.col("tissue_site").isNull(), "TCGA").otherwise("GTEx"), "place": F.coalesce("project_id", "tissue_site")})
    keys = ["source", "place"]
    values = group_quantiles(rows, keys, "expression_value", {"median_expression": 0.5}, mean="mean_expression")
    counts = rows.groupBy(*keys).agg(F.max("project_id").alias("project_id"), F.max("tissue_site").alias("tissue_site"), F.count_distinct("sample_id").alias("sample_count"))
    return counts.join(values, keys).select("source", "project_id", "tissue_site", "median_expression", "mean_expression", "sample_count")


def cohort_distribution(samples: DataFrame, by: str, *, projects: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Distinct samples per label of ``by``, after optional multi-select filters."""
    kept = samples if not projects else samples.where(F.col("project_id").isin(*projects))
    kept = kept if not types else kept.where(F.col("sample_type").isin(*types))
    return kept.groupBy(F.col(by).alias("label")).agg(F.count_distinct("sample_id").alias("count"))


def class_breakdown(frequency: DataFrame) -> DataFrame:
    return frequency.groupBy("cancer_type", "top_variant_classification").agg(F.count(F.lit(1)).alias("gene_count"))


def exactly_one(df: DataFrame, what: str) -> DataFrame:
    """The single matching row; anything else is an error (looks at two rows at most)."""
    if df.limit(2).count() != 1:
        raise ValueError(f"expected exactly one {what}")
    return df
