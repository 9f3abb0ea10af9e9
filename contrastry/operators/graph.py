"""Knowledge graph as two tables: build, public filter, degree metrics and queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastry.functions.ordered import ordered_rank, row_rank
from contrastry.session import materialize

NODE = ["node_id", "node_label", "name", "primary_site", "source"]
EDGE = ["edge_id", "source_node_id", "target_node_id", "edge_type", "weight", "evidence_source"]

# Labels that may be published, and the data sets behind the graph.
PUBLIC_LABELS = ("CancerType", "Dataset", "Gene", "Pathway", "Tissue")
DATASETS = (("DATASET:TCGA", "Dataset", "TCGA", "Multi", "TCGA"), ("DATASET:GTEX", "Dataset", "GTEx", "Multi", "GTEx"))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _node(df: DataFrame, prefix: str, key: str, label: str, site: Column, source: Column, name: str | None = None) -> DataFrame:
    return df.select(
        F.concat(F.lit(prefix), F.col(key)).alias("node_id"), F.lit(label).alias("node_label"),
        F.col(name or key).alias("name"), site.alias("primary_site"), source.alias("source"),
    )


def gene_nodes(sources: dict[str, DataFrame]) -> DataFrame:
    """Gene nodes from any tables with ``gene_symbol``; sources merge into a sorted ``/`` list."""
    tagged = _union([df.select(F.col("gene_symbol").cast("string"), F.lit(s).alias("gene_source")).distinct() for s, df in sources.items()])
    merged = tagged.where(F.col("gene_symbol") != "").groupBy("gene_symbol").agg(
        F.array_join(F.array_sort(F.collect_set("gene_source")), "/").alias("gene_source")
    )
    return _node(merged, "GENE:", "gene_symbol", "Gene", F.lit("Unknown"), F.col("gene_source"))


def graph_nodes(
    projects: DataFrame, samples: DataFrame | None, patients: DataFrame | None, tumour: DataFrame, reference: DataFrame,
    pathways: DataFrame, memberships: DataFrame,
) -> DataFrame:
    """Seven node families, one row per (node_id, node_label); without samples and patients the five that may be published."""
    spark = projects.sparkSession
    families = [
        _node(projects, "", "project_id", "CancerType", F.col("primary_site"), F.lit("TCGA")),
        gene_nodes({"TCGA": tumour, "GTEx": reference, "Reactome": memberships}),
        _node(pathways, "PATHWAY:", "pathway_id", "Pathway", F.lit("Multi"), F.col("pathway_source"), name="pathway_name"),
        *([_node(samples, "SAMPLE:", "sample_id", "Sample", F.col("project_id"), F.lit("TCGA"))] if samples is not None else []),
        *([_node(patients, "PATIENT:", "case_id", "Patient", F.col("project_id"), F.lit("TCGA"))] if patients is not None else []),
        _node(reference.select("tissue_site").distinct(), "TISSUE:", "tissue_site", "Tissue", F.col("tissue_site"), F.lit("GTEx")),
        spark.createDataFrame(list(DATASETS), ", ".join(f"{c} string" for c in NODE)),
    ]
    # the smallest attributes win, so duplicates resolve the same way on every run
    return _union(families).groupBy("node_id", "node_label").agg(*[F.min(c).alias(c) for c in NODE[2:]]).select(*NODE)


def is_individual(c: str) -> Column:
    """Whether an id names a case or a sample."""
    return F.col(c).startswith("PATIENT:") | F.col(c).startswith("SAMPLE:")


def individual_nodes(projects: DataFrame, samples: DataFrame, patients: DataFrame) -> DataFrame:
    """Rows of the three node families that can name individuals, repeated as their tables repeat them: the ids of
    the others begin with a prefix of their own."""
    return _union([
        _node(projects, "", "project_id", "CancerType", F.col("primary_site"), F.lit("TCGA")),
        _node(samples, "SAMPLE:", "sample_id", "Sample", F.col("project_id"), F.lit("TCGA")),
        _node(patients, "PATIENT:", "case_id", "Patient", F.col("project_id"), F.lit("TCGA")),
    ])


def _edge(df: DataFrame, kind: str, source: Column, target: Column, parts: Sequence[str], weight: Column, evidence: Column) -> DataFrame:
    edge_id = F.concat_ws(":", F.lit(kind), *[F.col(p) for p in parts])
    return df.select(
        edge_id.alias("edge_id"), source.alias("source_node_id"), target.alias("target_node_id"),
        F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"), evidence.alias("evidence_source"),
    )


def _id(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), F.col(name))


def sample_edges(samples: DataFrame) -> DataFrame:
    return _edge(samples, "HAS_SAMPLE", _id("PATIENT:", "case_id"), _id("SAMPLE:", "sample_id"), ["case_id", "sample_id"], F.lit(1.0), F.lit("TCGA"))


def cancer_edges(samples: DataFrame) -> DataFrame:
    return _edge(samples, "BELONGS_TO_CANCER", _id("SAMPLE:", "sample_id"), F.col("project_id"), ["sample_id", "project_id"], F.lit(1.0), F.lit("TCGA"))


def tissue_edges(reference: DataFrame) -> DataFrame:
    """Mean log2 expression per gene and tissue (``log2_expression`` is derived if absent)."""
    level = F.col("log2_expression") if "log2_expression" in reference.columns else F.log2(F.col("expression_value") + 1.0)
    means = reference.groupBy("gene_symbol", "tissue_site").agg(F.avg(level).alias("mean_level"))
    return _edge(means, "EXPRESSED_IN_TISSUE", _id("GENE:", "gene_symbol"), _id("TISSUE:", "tissue_site"), ["gene_symbol", "tissue_site"], F.col("mean_level"), F.lit("GTEx"))


def mutation_edges(mutation_by_gene: DataFrame) -> DataFrame:
    return _edge(mutation_by_gene, "MUTATED_IN_CANCER", _id("GENE:", "gene_symbol"), F.col("cancer_type"), ["gene_symbol", "cancer_type"], F.col("mutation_frequency"), F.lit("TCGA"))


def overexpression_edges(contrast: DataFrame, *, top_n: int = 100) -> DataFrame:
    """Optional family: the ``top_n`` genes per cohort by log2 fold change."""
    ranked = row_rank(contrast.where(F.col("log2_fold_change") > 0), ["cancer_type"], "log2_fold_change", ["gene_symbol"], "place")
    return _edge(ranked.where(F.col("place") <= top_n), "OVEREXPRESSED_IN", _id("GENE:", "gene_symbol"), F.col("cancer_type"), ["gene_symbol", "cancer_type"], F.col("log2_fold_change"), F.lit("TCGA"))


def select_pathways(enrichment: DataFrame, *, max_per_cancer: int = 50, max_fdr: float = 0.05) -> DataFrame:
    """Best enriched row per (cancer, pathway), then the leading pathways of each cancer."""
    if max_per_cancer < 1 or not 0.0 <= max_fdr <= 1.0:
        raise ValueError("max_per_cancer must be positive and max_fdr within [0, 1]")
    order = [F.col("fdr_q_value"), F.col("enrichment_score").desc(), F.col("overlap_gene_count").desc(), F.col("pathway_id"), F.col("candidate_set")]
    # both windows hold at most (pathways x candidate sets) of one cohort: a catalogue, not data
    best = Window.partitionBy("cancer_type", "pathway_id").orderBy(*order)
    lead = Window.partitionBy("cancer_type").orderBy(*order)
    return (
        enrichment.where((F.col("enrichment_tier") == "fdr_enriched") & (F.col("fdr_q_value") <= max_fdr))
        .withColumn("_best", F.row_number().over(best)).where(F.col("_best") == 1)
        .withColumn("_lead", F.row_number().over(lead)).where(F.col("_lead") <= max_per_cancer)
        .drop("_best", "_lead")
    )


def selected_memberships(selected: DataFrame, gene_sets: DataFrame) -> DataFrame:
    return gene_sets.join(selected.select("pathway_id").distinct(), "pathway_id", "left_semi").select(
        "pathway_id", "pathway_name", "pathway_source", "gene_symbol"
    ).dropDuplicates(["pathway_id", "gene_symbol"])


def enrichment_edges(selected: DataFrame) -> DataFrame:
    evidence = F.concat(F.col("pathway_source"), F.lit(":ORA:"), F.col("candidate_set"))
    return _edge(selected, "ENRICHED_IN_CANCER", _id("PATHWAY:", "pathway_id"), F.col("cancer_type"), ["pathway_id", "cancer_type"], F.col("enrichment_score"), evidence)


def membership_edges(memberships: DataFrame) -> DataFrame:
    return _edge(memberships, "MEMBER_OF_PATHWAY", _id("GENE:", "gene_symbol"), _id("PATHWAY:", "pathway_id"), ["gene_symbol", "pathway_id"], F.lit(1.0), F.col("pathway_source"))


def union_edges(*families: DataFrame) -> DataFrame:
    """All families, one row per edge_id."""
    return _union(families).groupBy("edge_id").agg(*[F.min(c).alias(c) for c in EDGE[1:]]).select(*EDGE)


def public_nodes(nodes: DataFrame, labels: Sequence[str] = PUBLIC_LABELS) -> DataFrame:
    return nodes.where(F.col("node_label").isin(*labels))


def public_edges(nodes: DataFrame, edges: DataFrame, labels: Sequence[str] = PUBLIC_LABELS) -> DataFrame:
    """Edges whose both ends are public nodes."""
    ids = public_nodes(nodes, labels).select("node_id").distinct()
    return edges.join(ids, F.col("source_node_id") == ids.node_id, "left_semi").join(
        ids, F.col("target_node_id") == ids.node_id, "left_semi"
    )


def public_audit(nodes: DataFrame, edges: DataFrame, labels: Sequence[str] = PUBLIC_LABELS) -> DataFrame:
    """Input, kept and excluded counts as one row."""
    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    counted = nodes.sparkSession.range(1).select(
        rows(nodes).alias("input_nodes"), rows(public_nodes(nodes, labels)).alias("public_nodes"),
        rows(edges).alias("input_edges"), rows(public_edges(nodes, edges, labels)).alias("public_edges"),
    )
    return counted.withColumns({
        "excluded_nodes": F.col("input_nodes") - F.col("public_nodes"), "excluded_edges": F.col("input_edges") - F.col("public_edges")
    })


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees, weight sums and edge-type counts per node, with a global rank.

    Each edge contributes an outgoing and an incoming end; ends are first summed per
    (node, side, edge type), so hubs combine before the shuffle.
    """
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))
    ends = edges.select(
        F.explode(F.array(
            F.struct(F.lit("out").alias("side"), F.col("source_node_id").alias("node_id")),
            F.struct(F.lit("in").alias("side"), F.col("target_node_id").alias("node_id")),
        )).alias("end"), "edge_type", weight.alias("w"),
    ).select("end.side", "end.node_id", "edge_type", "w")
    by_type = ends.groupBy("node_id", "side", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    totals = by_type.groupBy("node_id").agg(
        F.sum("n").alias("total_degree"),
        F.sum(F.when(F.col("side") == "in", F.col("n")).otherwise(0)).alias("in_degree"),
        F.sum(F.when(F.col("side") == "out", F.col("n")).otherwise(0)).alias("out_degree"),
        F.sum("w").alias("weighted_degree"),
        F.count(F.lit(1)).alias("edge_type_count"),
    )
    zeros = {c: 0 for c in ("total_degree", "in_degree", "out_degree", "edge_type_count")}
    joined = nodes.select("node_id", "node_label", "name").join(totals, "node_id", "left").fillna({**zeros, "weighted_degree": 0.0})
    # leaves tie on degree and weight in masses: the ids take part in the ranges
    ranked = ordered_rank(joined, [], [F.col("total_degree").desc(), F.col("weighted_degree").desc(), F.col("node_id")], "degree_rank")
    return ranked.select(
        "node_id", "node_label", "name", "total_degree", "in_degree", "out_degree", "weighted_degree", "edge_type_count", "degree_rank"
    )


def top_nodes(metrics: DataFrame, limit: int = 20, label: str | None = None) -> DataFrame:
    kept = metrics if label is None else metrics.where(F.col("node_label") == label)
    return kept.orderBy(F.col("total_degree").desc(), F.col("weighted_degree").desc(), "node_id").limit(limit)


def edge_type_summary(edges: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edge_count"), F.avg(weight).alias("mean_weight"))


def touching_edges(
    nodes: DataFrame, edges: DataFrame, *, edge_types: Sequence[str] | None = None, node_query: str | None = None,
) -> DataFrame:
    """All public edges of the given types touching a node that matches the text."""
    kept = public_edges(nodes, edges)
    if edge_types:
        kept = kept.where(F.col("edge_type").isin(*edge_types))
    if node_query:
        text = node_query.upper()
        hit = F.lit(False)
        for c in ("node_id", "name", "node_label"):
            hit = hit | F.upper(F.col(c).cast("string")).contains(text)
        ids = public_nodes(nodes).where(hit).select("node_id").distinct()
        # two equi-joins: an OR over both ends would become a nested-loop join
        source = ids.select(F.col("node_id").alias("source_node_id"), F.lit(True).alias("_s"))
        target = ids.select(F.col("node_id").alias("target_node_id"), F.lit(True).alias("_t"))
        kept = kept.join(source, "source_node_id", "left").join(target, "target_node_id", "left").where(
            F.col("_s").isNotNull() | F.col("_t").isNotNull()
        )
    return kept.select(*EDGE)


def neighbourhood_edges(
    nodes: DataFrame, edges: DataFrame, *, edge_types: Sequence[str] | None = None, node_query: str | None = None, max_rows: int = 500
) -> DataFrame:
    """The first of the touching edges; ``neighbourhood_counts`` tells how many there are."""
    return touching_edges(nodes, edges, edge_types=edge_types, node_query=node_query).orderBy("edge_id").limit(max_rows)


def neighbourhood_counts(nodes: DataFrame, edges: DataFrame, *, edge_types: Sequence[str] | None = None, node_query: str | None = None, max_rows: int = 500) -> DataFrame:
    """Edges by type and their end nodes by label, before any cut: (kind, name, n, total, shown)."""
    kept = materialize(touching_edges(nodes, edges, edge_types=edge_types, node_query=node_query), "neighbourhood")
    ends = kept.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).distinct()
    counted = kept.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        public_nodes(nodes).join(ends, "node_id", "left_semi").groupBy(F.lit("node").alias("kind"), F.col("node_label").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    # a handful of rows: one for each type and label
    total = F.sum("n").over(Window.partitionBy("kind"))
    return counted.withColumn("total", total).withColumn("shown", F.least("total", F.lit(max_rows)).cast("long"))


def induced_nodes(nodes: DataFrame, edges: DataFrame, max_rows: int = 500) -> DataFrame:
    """Public nodes at either end of the given edges."""
    ends = edges.select(F.col("source_node_id").alias("node_id")).unionByName(edges.select(F.col("target_node_id").alias("node_id"))).distinct()
    return public_nodes(nodes).join(ends, "node_id", "left_semi").select(*NODE).orderBy("node_id", "node_label").limit(max_rows)


def enriched_pathway_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Enrichment edges with their pathway's name, strongest first."""
    names = nodes.where(F.col("node_label") == "Pathway").select(F.col("node_id").alias("source_node_id"), F.col("name").alias("pathway_name"))
    return edges.where(F.col("edge_type") == "ENRICHED_IN_CANCER").join(names, "source_node_id").select(
        F.col("target_node_id").alias("cancer_type"), "pathway_name", F.col("weight").alias("enrichment_score"), "evidence_source"
    )


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))
    return nodes.sparkSession.range(1).select(nodes.agg(rows).scalar().alias("node_count"), edges.agg(rows).scalar().alias("edge_count"))
