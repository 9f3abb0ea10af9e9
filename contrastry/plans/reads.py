"""Read queries, quality rules and release audits, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrastry.functions.expr import rounded
from contrastry.operators import graph as g_ops
from contrastry.operators import lookups as l_ops
from contrastry.operators import quality as q_ops
from contrastry.operators import release as x_ops
from contrastry.plans import files
from contrastry.plans import gold_contrasts as gc
from contrastry.plans import gold_evidence as ge
from contrastry.plans import gold_statistics as gs
from contrastry.plans import studies as st
from contrastry.plans import views as v
from contrastry.plans import warehouse
from contrastry.session import schemas_only
from contrastry.sources import sinks

COHORT, GENE = "BUILDING", "BRAND#12_PROMO"


def _look(mart, name, **kw):
    return lambda s, d: rounded(l_ops.lookup(mart(s, d), name, **kw))


def _contrast(s, d):
    return gc.settled(gc.contrast(s, d))


def keyed_measurements(s, d):
    """Both arms' measurements under one upper-case gene key, laid out for look-ups; written once per session."""
    columns = ["gene_key", "project_id", "tissue_site", "sample_id", "expression_value"]
    tumour = v.tumour(s, d).withColumn("tissue_site", F.lit(None).cast("string"))
    reference = v.reference(s, d).withColumns({"project_id": F.lit(None).cast("string"), "sample_id": F.col("gtex_sample_id")})
    both = [x.withColumn("gene_key", F.upper("gene_symbol")).select(*columns) for x in (tumour, reference)]
    return both[0].unionByName(both[1])


def _gene_rows(s, d):
    path = warehouse.once(s, d, "keyed_measurements", lambda to: sinks.write_lookup(keyed_measurements(s, d), to, "gene_key", spread=("sample_id",), files=64))
    return l_ops.gene_measurements(sinks.read_lookup(s, path, "gene_key", GENE))


def _contrast_rows(s, d):
    """The contrast by gene from a table laid out for it."""
    path = warehouse.once(s, d, "keyed_contrast", lambda to: sinks.write_lookup(_contrast(s, d), to, "gene_symbol", spread=("cancer_type",), files=32))
    return rounded(l_ops.lookup(sinks.read_lookup(s, path, "gene_symbol", GENE), "tumour_vs_normal", equal={"gene_symbol": GENE}))


def _top(view: str, where: str, order: str, limit: int, ties: str = "cancer_type, gene_symbol") -> str:
    return f"SELECT * FROM {view} WHERE {where} ORDER BY {order}, {ties} LIMIT {limit}"


def _sql_top(view: str, where: str, order: str, limit: int, doubles: str = "", exclude: str = "", ties: str = "cancer_type, gene_symbol") -> str:
    inner = f"({_top(view, where, order, limit, ties)})"
    if exclude:
        inner = f"(SELECT * EXCLUDE ({exclude}) FROM {inner})"
    return v.sql(v.rounds(doubles, inner) if doubles else f"SELECT * FROM {inner}", view)


# ---------------------------------------------------------------- quality

def silver_tables(s, d):
    """The conformed tables, with some defects taken from the data so that rules have work."""
    mutations = ge.classified(s, d).withColumn("end_position", F.when(F.col("start_position") % 7 == 0, "n/a").otherwise(F.col("start_position").cast("string")))
    profile = v.profile(s, d).withColumns({
        "file_id": F.when(F.col("sample_id").endswith("3"), " ").otherwise(F.concat(F.lit("F-"), "sample_id")),
        "profile_status": F.when(F.col("sample_id").endswith("9"), "missing").otherwise("downloaded"),
    })
    return {
        "projects": ge.projects(s, d), "patients": ge.patients(s, d), "samples": ge.samples(s, d), "manifest": ge.manifest(s, d), "tumour": v.tumour(s, d),
        "reference": v.reference(s, d), "reprocessed": v.reprocessed(s, d), "mutations": mutations, "profile": profile,
    }


v.SQL_VIEWS["q_mutations"] = (("classified",), "SELECT *, CASE WHEN start_position % 7 = 0 THEN 'n/a' ELSE CAST(start_position AS VARCHAR) END AS end_position FROM classified")
v.SQL_VIEWS["q_profile"] = (("profile",), """SELECT *, CASE WHEN sample_id LIKE '%3' THEN ' ' ELSE 'F-' || sample_id END AS file_id,
    CASE WHEN sample_id LIKE '%9' THEN 'missing' ELSE 'downloaded' END AS profile_status FROM profile""")
v.SQL_VIEWS["q_tumour"] = (("tumour",), "SELECT *, 'TPM' AS expression_unit, 'STAR - Counts' AS pipeline_workflow FROM tumour")
v.SQL_VIEWS["q_reference"] = (("reference",), "SELECT *, 'TPM' AS expression_unit FROM reference")


def mart_tables(s, d):
    return {
        "mutation_frequency": ge.frequency_gene(s, d), "functional": ge.functional(s, d), "transcript": ge.transcript(s, d), "batch": gc.batch(s, d),
        "confidence": ge.confidence(s, d), "triangulation": gc.triangulation(s, d), "bootstrap": st.bootstrap(s, d), "validation": gc.validation(s, d),
        "statistics": gs.support(s, d), "paired": gs.paired(s, d), "enrichment": gs.enrichment(s, d), "comparison": st.comparison(s, d), "ablation": st.ablation(s, d),
    }


SILVER_SQL = {"projects": "projects", "manifest": "manifest", "tumour": "q_tumour", "reference": "q_reference", "reprocessed": "reprocessed", "mutations": "q_mutations", "profile": "q_profile"}
MART_SQL = {
    "mutation_frequency": "frequency_gene", "functional": "functional", "transcript": "transcript", "batch": "batch", "confidence": "confidence", "triangulation": "triangulation",
    "bootstrap": "bootstrap", "validation": "validation", "statistics": "support", "paired": "paired_support", "enrichment": "enrichment", "comparison": "comparison", "ablation": "ablation",
}


def _rules_sql(rules, names) -> str:
    parts = []
    for r in rules:
        text = r.violation.replace("as string)", "as varchar)").replace("'%htseq\\_counts%'", "'%htseq_counts%'")
        parts.append(f"SELECT '{r.name}' AS check_name, count(*) FILTER ({text}) AS failed_rows FROM {names[r.table]}")
    union = " UNION ALL ".join(parts)
    return v.sql(f"SELECT check_name, CASE WHEN failed_rows = 0 THEN 'passed' ELSE 'failed' END AS status, failed_rows FROM ({union})", *sorted(set(names[r.table] for r in rules)))


def key_checks(s, d):
    t = silver_tables(s, d)
    return q_ops.duplicate_keys(t["tumour"], ["project_id", "sample_id", "gene_id", "expression_unit"], "silver_expression_tcga_duplicate_measurement_keys").unionByName(
        q_ops.duplicate_keys(t["reference"], ["gtex_sample_id", "gene_id", "expression_unit"], "silver_expression_gtex_duplicate_measurement_keys")
    ).unionByName(q_ops.duplicate_known_ids(t["samples"], "sample_id", "silver_samples_duplicate_sample_id"))


def foreign_keys(s, d):
    t = silver_tables(s, d)
    checks = [
        q_ops.orphans(t["manifest"], t["samples"].select("project_id", "case_id"), ["project_id", "case_id"], "silver_samples_patient_fk_integrity"),
        q_ops.orphans(t["profile"], t["projects"], ["project_id"], "silver_samples_project_fk_integrity"),
        q_ops.orphans(q_ops.known_cases(t["mutations"]), t["patients"], ["project_id", "case_id"], "silver_mutations_case_fk_integrity"),
        q_ops.orphans(t["mutations"], t["profile"].where("profile_status = 'downloaded'"), ["project_id", "sample_id"], "silver_mutation_samples_in_profile", distinct=True),
        q_ops.dangling_edges(g_ops.public_nodes(ge.nodes(s, d)), ge.edges(s, d)),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def support_checks(s, d):
    return q_ops.minimum_support(v.reference(s, d), "tissue_site", "gtex_sample_id", "silver_expression_gtex_min_tissue_sample_support").unionByName(
        q_ops.minimum_column(gc.triangulation(s, d), "sample_count_tcga_normal", "gold_reference_triangulation_min_tcga_normal_support"))


def live_sanity(s, d):
    return q_ops.non_empty({"tumour": v.tumour(s, d), "mutations": ge.classified(s, d), "frequency": ge.frequency_gene(s, d), "closed": ge.manifest(s, d).where("access = 'sealed'")})


def schema_checks(s, d):
    """The columns of stored tables are read from their files, those of others from their plans: no mart is built for it."""
    with schemas_only():
        return q_ops.schema_presence(s, {**silver_tables(s, d), **mart_tables(s, d), "nodes": ge.nodes(s, d), "edges": ge.edges(s, d)})


def all_results(s, d):
    t = silver_tables(s, d)
    return (
        q_ops.row_rules(t, q_ops.SILVER_RULES).unionByName(q_ops.row_rules(mart_tables(s, d), q_ops.CONTRACT_RULES))
        .unionByName(key_checks(s, d)).unionByName(foreign_keys(s, d)).unionByName(schema_checks(s, d))
        .unionByName(live_sanity(s, d)).unionByName(files.integrity(s, d)).unionByName(support_checks(s, d).select(*q_ops.RESULT))
    )


DECLARED = (
    ("samples", "sample_id", "unique"), ("samples", "sample_id", "not_null"), ("samples", "sample_type", "accepted_values", ("Primary Tumor",)),
    ("projects", "project_id", "unique"), ("manifest", "access", "accepted_values", ("open",)),
)


# ---------------------------------------------------------------- lineage

def outcomes(s, d):
    """Manifest files with the fate their order status stands for."""
    letter = F.substring("file_size", -1, 1)
    return ge.manifest(s, d).select(
        "project_id", F.when(F.col("data_category").startswith("T"), "expression").otherwise("mutations").alias("modality"),
        F.when(letter < "4", "downloaded").when(letter < "6", "skipped").when(letter < "8", "failed").otherwise("not_selected").alias("status"),
    )


v.SQL_VIEWS["outcomes"] = (("manifest",), """
    SELECT project_id, CASE WHEN data_category LIKE 'T%' THEN 'expression' ELSE 'mutations' END AS modality,
           CASE WHEN right(file_size, 1) < '4' THEN 'downloaded' WHEN right(file_size, 1) < '6' THEN 'skipped' WHEN right(file_size, 1) < '8' THEN 'failed' ELSE 'not_selected' END AS status FROM manifest""")
_STUB = "regexp_matches(lower(coalesce(data_origin, '')), 'stub|placeholder|demo')"
v.SQL_VIEWS["parsed"] = (("tumour", "mutations"), f"""
    SELECT project_id, 'expression' AS modality, count(*) AS r, count(DISTINCT data_origin) AS f, count(*) FILTER ({_STUB}) AS b FROM tumour GROUP BY 1
    UNION ALL SELECT project_id, 'mutations', count(*), count(DISTINCT data_origin), count(*) FILTER ({_STUB}) FROM mutations GROUP BY 1""")


# Plain SQL over the marts; the same text runs in both engines.
SQL_TEXTS = {
    "sql_top_mutated_genes": ("frequency_gene", f"""SELECT gene_symbol, mutated_sample_count, total_profiled_sample_count, round(mutation_frequency, 6) AS mutation_frequency, top_variant_classification
        FROM frequency_gene WHERE cancer_type = '{COHORT}' ORDER BY frequency_gene.mutation_frequency DESC, mutated_sample_count DESC, gene_symbol LIMIT 20"""),
    "sql_concordant_triangulation": ("triangulation", """SELECT cancer_type, gene_symbol, round(log2_fc_tumor_vs_gtex, 6) AS log2_fc_tumor_vs_gtex, reference_concordance, reference_stability_score
        FROM triangulation WHERE reference_concordance LIKE 'concordant%' ORDER BY reference_stability_score DESC, reference_effect_delta, cancer_type, gene_symbol LIMIT 50"""),
    "sql_pathway_hits": ("enrichment", """SELECT cancer_type, candidate_set, pathway_id, pathway_gene_count, overlap_gene_count, overlap_genes, round(p_value, 6) AS p_value, enrichment_tier
        FROM enrichment WHERE overlap_gene_count >= 5 ORDER BY enrichment_score DESC, cancer_type, candidate_set, pathway_id LIMIT 50"""),
    "sql_edges_by_type": ("edges", """SELECT source_node_id, target_node_id, edge_type, round(weight, 6) AS weight FROM edges
        WHERE edge_type IN ('EXPRESSED_IN_TISSUE', 'MUTATED_IN_CANCER') ORDER BY edges.weight DESC, source_node_id, target_node_id LIMIT 100"""),
    "sql_consensus_by_tier": ("consensus", """SELECT cancer_type, publication_tier, count(*) AS genes, round(max(consensus_score), 6) AS best FROM consensus GROUP BY cancer_type, publication_tier"""),
}
SQL_MARTS = {"frequency_gene": ge.frequency_gene, "triangulation": gc.triangulation, "enrichment": gs.enrichment, "edges": ge.edges, "consensus": st.consensus}


def _text_query(name):
    view, text = SQL_TEXTS[name]

    def query(s, d):
        l_ops.register_views({view: SQL_MARTS[view](s, d)})
        return s.sql(text)

    return query


def traced(s, d):
    return x_ops.traceability(outcomes(s, d), {"expression": v.tumour(s, d), "mutations": v.mutations(s, d)})


def shifted_percentiles(s, d):
    """The batch mart with some percentiles moved: the faults that the rank check has to find."""
    moved = {"tumor_expression_percentile": ("1", 0.01), "normal_expression_percentile": ("2", -0.00001)}
    return gc.batch(s, d).withColumns({c: F.col(c) + F.when(F.col("gene_symbol").contains(mark), F.lit(by)).otherwise(0.0) for c, (mark, by) in moved.items()})


def document_ids(s, d):
    """Customer names and document words as identifiers to look for in the documents' full texts."""
    words = v.table(s, d, "benchmark").select(F.explode(F.split("text", r"[^A-Za-z0-9_#-]+")).alias("identifier")).where(F.length("identifier") > 5)
    return words.unionByName(v.table(s, d, "customer").select(F.col("c_name").alias("identifier")))


def public_audit(s, d):
    """Identifier-like values in the full graph (individual nodes show, public labels do not)."""
    return x_ops.individual_values(ge.nodes(s, d))


def fingerprints(s, d):
    """The fingerprint of a table and of its rows in another order, which must agree."""
    lines = v.table(s, d, "lineitem")
    shuffled = lines.repartition("l_partkey").select(*reversed(lines.columns))
    other = x_ops.fingerprint(shuffled).select("fingerprint").scalar()
    return x_ops.fingerprint(lines).select("row_count", (F.col("fingerprint") == other).alias("order_independent"))


def frozen_plan_changes(s, d):
    """Orders by day against a frozen plan in which some days were absent, some orders stood otherwise, and one column was shifted."""
    orders = v.table(s, d, "orders").withColumn("day", F.unix_date(F.col("o_orderdate").cast("date")))
    number = F.col("o_orderkey")
    earlier = orders.where(F.col("day") % 29 != 0).withColumns({
        "o_orderstatus": F.when(number % 997 == 0, "?").otherwise(F.col("o_orderstatus")),
        "o_custkey": F.when(number % 1009 == 0, F.lit(None)).otherwise(F.col("o_custkey")),
    })
    return x_ops.plan_changes(x_ops.fingerprint(orders.where(F.col("day") % 31 != 0), ["day"]), x_ops.fingerprint(earlier, ["day"]), ["day"])


QUERIES = {
    # reads
    "project_list": lambda s, d: l_ops.project_list(ge.projects(s, d)),
    "project_samples": lambda s, d: l_ops.project_samples(ge.samples(s, d), COHORT),
    "gene_search": lambda s, d: l_ops.gene_search([v.tumour(s, d), v.reference(s, d), v.reprocessed(s, d)], "brand#1"),
    "expression_by_gene": lambda s, d: rounded(gc.settled(_gene_rows(s, d), "mean_expression")),
    "tumour_vs_normal_lookup": _contrast_rows,
    "top_overexpressed": _look(_contrast, "tumour_vs_normal", equal={"cancer_type": COHORT}, limit=20),
    "mutation_by_gene_lookup": _look(ge.frequency_gene, "mutation_frequency", equal={"gene_symbol": "BRAND#12_STANDARD"}),
    "top_mutated_genes": _look(ge.frequency_gene, "mutation_frequency", equal={"cancer_type": COHORT}, limit=20),
    "candidate_priority_lookup": _look(ge.priority, "candidate_priority", equal={"priority_tier": "medium"}, text="brand#1", at_least={"priority_score": 0.2}, limit=25),
    "candidate_priority_total": lambda s, d: l_ops.total_matching(ge.priority(s, d), "candidate_priority", equal={"priority_tier": "medium"}, text="brand#1"),
    "evidence_confidence_lookup": _look(ge.confidence, "evidence_confidence", equal={"batch_concordance": "concordant"}, at_least={"overall_confidence": 0.3}),
    "batch_sensitivity_lookup": _look(gc.batch, "batch_sensitivity", equal={"support_tier": "moderate"}, at_least={"percentile_delta": 0.1}),
    "reference_triangulation_lookup": _look(gc.triangulation, "reference_triangulation", at_least={"reference_stability_score": 0.3}),
    "bootstrap_stability_lookup": _look(st.bootstrap, "bootstrap_stability", at_least={"bootstrap_stability_score": 0.4}),
    "external_validation_lookup": _look(gc.validation, "external_validation", equal={"direction_agreement": "concordant"}, at_least={"validation_score": 0.5}),
    "consensus_lookup": lambda s, d: rounded(l_ops.lookup(st.consensus(s, d), "consensus_candidates", at_least={"consensus_score": 0.1}), 9),
    "expression_statistics_lookup": _look(gs.support, "expression_statistics", at_most={"recount3_fdr_q_value": 0.9}),
    "paired_expression_lookup": _look(gs.paired, "paired_expression", at_most={"paired_fdr_q_value": 1.0}),
    "pathway_enrichment_lookup": _look(gs.enrichment, "pathway_enrichment", text="set 1", at_least={"overlap_gene_count": 3}, ties=("cancer_type", "candidate_set", "pathway_id")),
    "cohort_summary_total": lambda s, d: ge.summary(s, d).select((F.col("tcga_expression_row_count") + F.col("gtex_expression_row_count") + F.col("mutation_record_count")).alias("total_rows")),
    "cohort_distribution_by_project": lambda s, d: l_ops.cohort_distribution(ge.samples(s, d), "project_id", types=["Primary Tumor"]),
    "cohort_distribution_by_type": lambda s, d: l_ops.cohort_distribution(ge.samples(s, d), "sample_type", projects=[COHORT, "MACHINERY"]),
    "mutation_landscape": _look(ge.frequency_gene, "mutation_frequency", equal={"cancer_type": COHORT}, text="promo"),
    "mutation_class_breakdown": lambda s, d: l_ops.class_breakdown(ge.frequency_gene(s, d)),
    "top_hub_genes": lambda s, d: rounded(g_ops.top_nodes(ge.metrics(s, d), 15, "Gene")),
    "pathways_by_cancer": lambda s, d: gs.enrichment(s, d).where(f"fdr_q_value <= {ge.MAX_FDR}").groupBy("cancer_type").agg(F.count(F.lit(1)).alias("pathway_count")),
    "edge_type_counts": lambda s, d: ge.edges(s, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("edge_count")),
    "single_gene_contrast_task": lambda s, d: rounded(l_ops.exactly_one(
        gc.contrast(s, d).where((F.col("cancer_type") == COHORT) & (F.col("gene_symbol") == GENE)), "contrast row").select("cancer_type", "gene_symbol", "log2_fold_change")),
    "ablation_summary": lambda s, d: st.ablation(s, d).where("top_k = 100").select(
        "cancer_type", "ablation_scenario", "top_k_jaccard", "spearman_consensus_score", "fixed_threshold_retention_rate", "sensitivity_tier"),
    "comparison_summary": lambda s, d: st.comparison(s, d).where("top_k = 100").select(
        "cancer_type", "method_a", "method_b", "common_gene_count", "top_k_jaccard", "regulated_direction_concordance", "spearman_abs_effect"),
    # quality
    "quality_silver_rules": lambda s, d: q_ops.row_rules(silver_tables(s, d), q_ops.SILVER_RULES),
    "quality_mart_contracts": lambda s, d: q_ops.row_rules(mart_tables(s, d), q_ops.CONTRACT_RULES),
    "quality_unique_keys": key_checks,
    "quality_foreign_keys": foreign_keys,
    "quality_minimum_support": lambda s, d: rounded(support_checks(s, d)),
    "quality_live_sanity": live_sanity,
    "quality_mapping_rate": lambda s, d: rounded(q_ops.mapping_rate(v.tumour(s, d), "data_origin")),
    "quality_midrank_violations": lambda s, d: q_ops.midrank_violations(shifted_percentiles(s, d)),
    "quality_multiset_parity": lambda s, d: rounded(q_ops.multiset_difference(
        ge.frequency_gene(s, d).select("cancer_type", "gene_symbol", "mutated_sample_count"), ge.functional(s, d).select("cancer_type", "gene_symbol", F.col("missense_sample_count").alias("mutated_sample_count")))),
    "quality_positive_gene_count": lambda s, d: ge.summary(s, d).where("gene_count > 0").select("gene_count"),
    "quality_declared_tests": lambda s, d: q_ops.declared_tests(silver_tables(s, d), DECLARED),
    "quality_row_minimums": lambda s, d: q_ops.row_minimums({k: silver_tables(s, d)[k] for k in ("tumour", "mutations", "profile")}, minimum=1000),
    "quality_stub_rows": lambda s, d: q_ops.stub_rows(v.tumour(s, d)),
    "quality_individual_leaks": lambda s, d: q_ops.individual_leaks(*ge.individual_graph(s, d), repeated=True),
    "quality_schema_presence": schema_checks,
    "quality_full_report": all_results,
    "quality_roll_up": lambda s, d: q_ops.roll_up(all_results(s, d)),
    "quality_status_counts": lambda s, d: q_ops.status_counts(all_results(s, d)),
    # lineage and release
    "ingestion_traceability": traced,
    "selection_counters": lambda s, d: x_ops.selection_counters(outcomes(s, d)),
    "individual_value_audit": public_audit,
    "leaked_identifiers": lambda s, d: x_ops.leaked_identifiers(v.table(s, d, "documents"), document_ids(s, d)),
    "resource_inventory": lambda s, d: x_ops.resource_inventory(s, {"contrast": gc.contrast(s, d), "priority": ge.priority(s, d), "public_nodes": g_ops.public_nodes(ge.nodes(s, d))}),
    "content_fingerprint": fingerprints,
    "frozen_plan_changes": frozen_plan_changes,
}

PRIORITY = "mutation_frequency abs_log2_fold_change log2_fold_change"
SQL = {
    "project_list": v.sql("SELECT * FROM projects", "projects"),
    "project_samples": v.sql(f"SELECT project_id, count(DISTINCT sample_id) AS sample_count, string_agg(DISTINCT sample_type, ',' ORDER BY sample_type) AS sample_types FROM samples WHERE project_id = '{COHORT}' GROUP BY 1", "samples"),
    "gene_search": v.sql("""SELECT DISTINCT gene_id, gene_symbol FROM (SELECT gene_id, gene_symbol FROM tumour UNION ALL SELECT gene_id, gene_symbol FROM reference UNION ALL SELECT gene_id, gene_symbol FROM reprocessed)
        WHERE contains(upper(gene_symbol), 'BRAND#1') OR contains(upper(gene_id), 'BRAND#1') ORDER BY gene_symbol, gene_id LIMIT 20""", "tumour", "reference", "reprocessed"),
    "expression_by_gene": v.sql(f"""SELECT 'TCGA' AS source, project_id, NULL AS tissue_site, round(median(expression_value), 6) AS median_expression, round(avg(expression_value) + 1e-9::DOUBLE, 6) AS mean_expression, count(DISTINCT sample_id) AS sample_count
        FROM tumour WHERE gene_symbol = '{GENE}' GROUP BY project_id UNION ALL SELECT 'GTEx', NULL, tissue_site, round(median(expression_value), 6), round(avg(expression_value) + 1e-9::DOUBLE, 6), count(DISTINCT gtex_sample_id)
        FROM reference WHERE gene_symbol = '{GENE}' GROUP BY tissue_site""", "tumour", "reference"),
    "tumour_vs_normal_lookup": v.sql(gc.settled_sql(v.rounds(gc.CONTRAST_DOUBLES, f"({_top('contrast', f"gene_symbol = '{GENE}'", 'log2_fold_change DESC', 50)})")), "contrast"),
    "top_overexpressed": v.sql(gc.settled_sql(v.rounds(gc.CONTRAST_DOUBLES, f"({_top('contrast', f"cancer_type = '{COHORT}'", 'log2_fold_change DESC', 20)})")), "contrast"),
    "mutation_by_gene_lookup": _sql_top("frequency_gene", "gene_symbol = 'BRAND#12_STANDARD'", "mutation_frequency DESC", 50, "mutation_frequency"),
    "top_mutated_genes": _sql_top("frequency_gene", f"cancer_type = '{COHORT}'", "mutation_frequency DESC", 20, "mutation_frequency"),
    "candidate_priority_lookup": _sql_top("priority", "priority_tier = 'medium' AND contains(gene_symbol, 'BRAND#1') AND priority_score >= 0.2",
                                          "priority_score DESC, evidence_count DESC, mutation_frequency DESC, abs_log2_fold_change DESC", 25, PRIORITY),
    "candidate_priority_total": v.sql("SELECT count(*) AS total_matching_rows FROM priority WHERE priority_tier = 'medium' AND contains(gene_symbol, 'BRAND#1')", "priority"),
    "evidence_confidence_lookup": _sql_top("confidence", "batch_concordance = 'concordant' AND overall_confidence >= 0.3", "overall_confidence DESC, priority_score DESC", 50, ge.CONFIDENCE_DOUBLES),
    "batch_sensitivity_lookup": _sql_top("batch", "support_tier = 'moderate' AND abs(percentile_delta) >= 0.1", "abs(percentile_delta) DESC, abs(robust_z_delta) DESC, sample_count_tumor DESC, sample_count_normal DESC", 50),
    "reference_triangulation_lookup": _sql_top("triangulation", "reference_stability_score >= 0.3", "reference_stability_score DESC, reference_effect_delta", 50, gc.TRIANGULATION_DOUBLES),
    "bootstrap_stability_lookup": v.sql(v.rounds(st.BOOT_DOUBLES, """(SELECT * EXCLUDE (score) FROM bootstrap WHERE round(bootstrap_stability_score, 6) >= 0.4
        ORDER BY round(bootstrap_stability_score, 6) DESC, priority_score DESC, cancer_type, gene_symbol LIMIT 50)"""), "bootstrap"),
    "external_validation_lookup": _sql_top("validation", "direction_agreement = 'concordant' AND validation_score >= 0.5", "validation_score DESC, effect_delta", 50),
    "consensus_lookup": v.sql(v.rounds(st.CONSENSUS_DOUBLES, f"({_top('consensus', 'consensus_score >= 0.1', 'consensus_score DESC, evidence_completeness DESC', 50)})", 9), "consensus"),
    "expression_statistics_lookup": _sql_top("support", "recount3_fdr_q_value <= 0.9", "statistical_support_score DESC, recount3_fdr_q_value", 50, gs.SUPPORT_DOUBLES, "same"),
    "paired_expression_lookup": _sql_top("paired_support", "paired_fdr_q_value <= 1", "paired_support_score DESC, paired_fdr_q_value", 50, gs.PAIRED_DOUBLES + " recount3_fdr_q_value recount3_rank_biserial paired_support_score"),
    "pathway_enrichment_lookup": _sql_top("enrichment", "(contains(upper(pathway_name), 'SET 1') OR contains(pathway_id, 'SET 1')) AND overlap_gene_count >= 3", "enrichment_score DESC, fdr_q_value", 50,
                                          gs.ENRICHMENT_DOUBLES, ties="cancer_type, candidate_set, pathway_id"),
    "cohort_summary_total": v.sql("SELECT (SELECT count(*) FROM tumour) + (SELECT count(*) FROM reference) + (SELECT count(*) FROM mutations) AS total_rows", "tumour", "reference", "mutations"),
    "cohort_distribution_by_project": v.sql("SELECT project_id AS label, count(DISTINCT sample_id) AS count FROM samples WHERE sample_type = 'Primary Tumor' GROUP BY 1", "samples"),
    "cohort_distribution_by_type": v.sql(f"SELECT sample_type AS label, count(DISTINCT sample_id) AS count FROM samples WHERE project_id IN ('{COHORT}', 'MACHINERY') GROUP BY 1", "samples"),
    "mutation_landscape": _sql_top("frequency_gene", f"cancer_type = '{COHORT}' AND contains(gene_symbol, 'PROMO')", "mutation_frequency DESC", 50, "mutation_frequency"),
    "mutation_class_breakdown": v.sql("SELECT cancer_type, top_variant_classification, count(*) AS gene_count FROM frequency_gene GROUP BY 1, 2", "frequency_gene"),
    "top_hub_genes": v.sql(v.rounds("weighted_degree", "(SELECT * FROM metrics WHERE node_label = 'Gene' ORDER BY total_degree DESC, weighted_degree DESC, node_id LIMIT 15)"), "metrics"),
    "pathways_by_cancer": v.sql(f"SELECT cancer_type, count(*) AS pathway_count FROM enrichment WHERE fdr_q_value <= {ge.MAX_FDR} GROUP BY 1", "enrichment"),
    "edge_type_counts": v.sql("SELECT edge_type, count(*) AS edge_count FROM edges GROUP BY 1", "edges"),
    "single_gene_contrast_task": v.sql(f"SELECT cancer_type, gene_symbol, round(log2_fold_change, 6) AS log2_fold_change FROM contrast WHERE cancer_type = '{COHORT}' AND gene_symbol = '{GENE}'", "contrast"),
    "ablation_summary": v.sql("SELECT cancer_type, ablation_scenario, top_k_jaccard, spearman_consensus_score, fixed_threshold_retention_rate, sensitivity_tier FROM ablation WHERE top_k = 100", "ablation"),
    "comparison_summary": v.sql("SELECT cancer_type, method_a, method_b, common_gene_count, top_k_jaccard, regulated_direction_concordance, spearman_abs_effect FROM comparison WHERE top_k = 100", "comparison"),
    "quality_silver_rules": _rules_sql(q_ops.SILVER_RULES, SILVER_SQL),
    "quality_mart_contracts": _rules_sql(q_ops.CONTRACT_RULES, MART_SQL),
    "quality_unique_keys": v.sql("""SELECT check_name, CASE WHEN failed_rows = 0 THEN 'passed' ELSE 'failed' END AS status, failed_rows FROM (
        SELECT 'silver_expression_tcga_duplicate_measurement_keys' AS check_name, count(*) - count(DISTINCT (project_id, sample_id, gene_id)) AS failed_rows FROM tumour
        UNION ALL SELECT 'silver_expression_gtex_duplicate_measurement_keys', count(*) - count(DISTINCT (gtex_sample_id, gene_id)) FROM reference
        UNION ALL SELECT 'silver_samples_duplicate_sample_id', count(*) FROM (SELECT sample_id FROM samples GROUP BY 1 HAVING count(*) > 1))""", "tumour", "reference", "samples"),
    "quality_foreign_keys": v.sql("""SELECT check_name, CASE WHEN failed_rows = 0 THEN 'passed' ELSE 'failed' END AS status, failed_rows FROM (
        SELECT 'silver_samples_patient_fk_integrity' AS check_name, count(*) AS failed_rows FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.project_id = m.project_id AND s.case_id = m.case_id)
        UNION ALL SELECT 'silver_samples_project_fk_integrity', count(*) FROM profile WHERE project_id NOT IN (SELECT project_id FROM projects)
        UNION ALL SELECT 'silver_mutations_case_fk_integrity', count(*) FROM mutations m WHERE NOT EXISTS (SELECT 1 FROM patients s WHERE s.project_id = m.project_id AND s.case_id = m.case_id)
        UNION ALL SELECT 'silver_mutation_samples_in_profile', count(*) FROM (SELECT DISTINCT project_id, sample_id FROM mutations) m WHERE NOT EXISTS (SELECT 1 FROM q_profile p WHERE p.project_id = m.project_id AND p.sample_id = m.sample_id AND profile_status = 'downloaded')
        UNION ALL SELECT 'gold_graph_edges_node_fk_integrity', count(*) FROM edges WHERE source_node_id NOT IN (SELECT node_id FROM public_nodes) OR target_node_id NOT IN (SELECT node_id FROM public_nodes))""",
        "manifest", "samples", "profile", "projects", "mutations", "patients", "q_profile", "edges", "public_nodes"),
    "quality_minimum_support": v.sql("""SELECT check_name, CASE WHEN m >= 30 THEN 'passed' ELSE 'warning' END AS status, CASE WHEN m >= 30 THEN 0 ELSE 1 END::BIGINT AS failed_rows, 'min_samples' AS metric_name, m::DOUBLE AS metric_value, 30.0::DOUBLE AS threshold FROM (
        SELECT 'silver_expression_gtex_min_tissue_sample_support' AS check_name, min(n) AS m FROM (SELECT count(DISTINCT gtex_sample_id) AS n FROM reference GROUP BY tissue_site)
        UNION ALL SELECT 'gold_reference_triangulation_min_tcga_normal_support', min(sample_count_tcga_normal) FROM triangulation)""", "reference", "triangulation"),
    "quality_live_sanity": "SELECT 'live_mode_non_zero_row_sanity' AS check_name, 'failed' AS status, 1::BIGINT AS failed_rows FROM (SELECT count(*) AS n FROM events) WHERE n > 0",
    "quality_mapping_rate": v.sql("SELECT 'gene_mapping_rate' AS check_name, CASE WHEN r >= 0.98 THEN 'passed' ELSE 'warning' END AS status, 'mapping_rate' AS metric_name, round(r, 6) AS metric_value, 0.98::DOUBLE AS threshold FROM (SELECT avg((data_origin <> '')::INT) AS r FROM tumour)", "tumour"),
    "quality_midrank_violations": v.sql("""SELECT cancer_type, gene_symbol FROM (
        SELECT *, CASE WHEN n > 1 THEN (rt - 1) / (n - 1) ELSE 0.5 END AS pt, CASE WHEN n > 1 THEN (rn - 1) / (n - 1) ELSE 0.5 END AS pn FROM (
          SELECT *, count(*) OVER (PARTITION BY cancer_type) AS n,
            rank() OVER (PARTITION BY cancer_type ORDER BY tumor_log2_median) + (count(*) OVER (PARTITION BY cancer_type, tumor_log2_median) - 1) / 2.0::DOUBLE AS rt,
            rank() OVER (PARTITION BY cancer_type ORDER BY normal_log2_median) + (count(*) OVER (PARTITION BY cancer_type, normal_log2_median) - 1) / 2.0::DOUBLE AS rn FROM batch))
        WHERE abs(pt - (tumor_expression_percentile + CASE WHEN gene_symbol LIKE '%1%' THEN 0.01 ELSE 0 END)) > 1e-6
           OR abs(pn - (normal_expression_percentile - CASE WHEN gene_symbol LIKE '%2%' THEN 0.00001 ELSE 0 END)) > 1e-6""", "batch"),
    "quality_multiset_parity": v.sql("""SELECT *, 'first' AS side FROM (SELECT cancer_type, gene_symbol, mutated_sample_count FROM frequency_gene EXCEPT ALL SELECT cancer_type, gene_symbol, missense_sample_count FROM functional)
        UNION ALL SELECT *, 'second' FROM (SELECT cancer_type, gene_symbol, missense_sample_count FROM functional EXCEPT ALL SELECT cancer_type, gene_symbol, mutated_sample_count FROM frequency_gene)""", "frequency_gene", "functional"),
    "quality_positive_gene_count": v.sql("SELECT count(DISTINCT gene_id) AS gene_count FROM (SELECT gene_id FROM tumour UNION ALL SELECT gene_id FROM reference)", "tumour", "reference"),
    "quality_declared_tests": v.sql("""SELECT check_name, CASE WHEN failed_rows = 0 THEN 'passed' ELSE 'failed' END AS status, failed_rows FROM (
        SELECT 'samples.sample_id.unique' AS check_name, count(*) AS failed_rows FROM (SELECT sample_id FROM samples GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'samples.sample_id.not_null', count(*) FILTER (sample_id IS NULL) FROM samples UNION ALL SELECT 'samples.sample_type.accepted_values', count(*) FILTER (sample_type <> 'Primary Tumor') FROM samples
        UNION ALL SELECT 'projects.project_id.unique', count(*) FROM (SELECT project_id FROM projects GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'manifest.access.accepted_values', count(*) FILTER (access <> 'open') FROM manifest)""",
        "samples", "projects", "manifest"),
    "quality_row_minimums": v.sql("""SELECT 'tumour' AS check_name, count(*) AS row_count, count(*) >= 1000 AS passed FROM tumour UNION ALL SELECT 'mutations', count(*), count(*) >= 1000 FROM mutations
        UNION ALL SELECT 'profile', count(*), count(*) >= 1000 FROM profile""", "tumour", "mutations", "profile"),
    "quality_stub_rows": v.sql(f"SELECT count(*) FILTER ({_STUB}) AS stub_like_rows, count(*) AS row_count, count(*) FILTER (NOT {_STUB} AND data_origin <> '') AS public_rows FROM tumour", "tumour"),
    "quality_individual_leaks": v.sql("""SELECT (SELECT count(*) FROM nodes WHERE node_label IN ('Patient', 'Sample')) AS disallowed_nodes,
        (SELECT count(*) FROM edges WHERE source_node_id LIKE 'PATIENT:%' OR source_node_id LIKE 'SAMPLE:%' OR target_node_id LIKE 'PATIENT:%' OR target_node_id LIKE 'SAMPLE:%') AS disallowed_edges""", "nodes", "edges"),
    "ingestion_traceability": v.sql("""SELECT project_id, modality, coalesce(c, 0) AS candidate_files, coalesce(sel, 0) AS selected_files, coalesce(dl, 0) AS downloaded_files, coalesce(sk, 0) AS skipped_existing_files, coalesce(fl, 0) AS failed_files,
        coalesce(loc, 0) AS local_available_files, coalesce(r, 0) AS silver_parsed_rows, coalesce(f, 0) AS silver_unique_source_files, coalesce(b, 0) AS silver_stub_rows, round(coalesce(f, 0) / nullif(loc, 0), 4) AS parsed_vs_local_file_ratio,
        concat_ws(';', CASE WHEN coalesce(loc, 0) > 0 AND coalesce(r, 0) = 0 THEN 'local_files_without_parsed_rows' END, CASE WHEN coalesce(b, 0) > 0 THEN 'stub_origin_rows' END) AS warnings
        FROM (SELECT project_id, modality, count(*) AS c, count(*) FILTER (status <> 'not_selected') AS sel, count(*) FILTER (status = 'downloaded') AS dl, count(*) FILTER (status = 'skipped') AS sk,
                     count(*) FILTER (status = 'failed') AS fl, count(*) FILTER (status IN ('downloaded', 'skipped')) AS loc FROM outcomes GROUP BY 1, 2) FULL JOIN parsed USING (project_id, modality)""", "outcomes", "parsed"),
    "selection_counters": v.sql("""SELECT project_id, modality, count(*) FILTER (status = 'downloaded') AS downloaded, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status = 'not_selected') AS not_selected FROM outcomes GROUP BY 1, 2""", "outcomes"),
    "individual_value_audit": v.sql(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (regexp_matches(trim({c}), '(?i)^(PATIENT|SAMPLE|CASE|DONOR):') OR regexp_matches(trim({c}), '(?i)^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}(-|$)') "
        f"OR regexp_matches(trim({c}), '(?i)^GTEX-[A-Z0-9]{{4,}}(-|$)')) AS individual_like_rows FROM nodes" for c in g_ops.NODE), "nodes"),
    "leaked_identifiers": """SELECT identifier, count(*) AS occurrences FROM documents JOIN (
        SELECT DISTINCT identifier FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_#-]+')) AS identifier FROM benchmark UNION ALL SELECT c_name FROM customer) WHERE length(identifier) >= 6
        ) ids ON contains(text, identifier) GROUP BY 1""",
    "resource_inventory": v.sql("""SELECT 'contrast' AS name, count(*) AS row_count, 9::BIGINT AS column_count, 2::BIGINT AS string_columns, 2::BIGINT AS integer_columns, 5::BIGINT AS number_columns, 0::BIGINT AS boolean_columns FROM contrast
        UNION ALL SELECT 'priority', count(*), 12, 4, 4, 4, 0 FROM priority UNION ALL SELECT 'public_nodes', count(*), 5, 5, 0, 0, 0 FROM public_nodes""", "contrast", "priority", "public_nodes"),
    "content_fingerprint": "SELECT count(*) AS row_count, true AS order_independent FROM lineitem",
    # rows themselves are compared here, not their hashes
    "frozen_plan_changes": """WITH days AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day FROM orders),
        now AS (SELECT * FROM days WHERE day % 31 <> 0),
        earlier AS (SELECT * REPLACE (CASE WHEN o_orderkey % 997 = 0 THEN '?' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 1009 <> 0 THEN o_custkey END AS o_custkey)
                    FROM days WHERE day % 29 <> 0),
        moved AS (SELECT DISTINCT day FROM ((SELECT * FROM now EXCEPT ALL SELECT * FROM earlier) UNION ALL (SELECT * FROM earlier EXCEPT ALL SELECT * FROM now)))
        SELECT day, CASE WHEN rows_before IS NULL THEN 'added' WHEN rows_after IS NULL THEN 'removed' WHEN day IN (FROM moved) THEN 'changed' ELSE 'unchanged' END AS change, rows_before, rows_after
        FROM (SELECT day, count(*) AS rows_before FROM earlier GROUP BY 1) FULL JOIN (SELECT day, count(*) AS rows_after FROM now GROUP BY 1) USING (day)""",
}


def _schema_sql() -> str:
    """Columns that a table lacks, by the twins' own schemas; constants of the conformed rows are not in their twins."""
    views = {**SILVER_SQL, **MART_SQL, "samples": "samples", "nodes": "nodes", "edges": "edges"}
    parts = []
    for name, table, columns in q_ops.REQUIRED_COLUMNS:
        wanted = ", ".join(f"('{c}')" for c in columns.split())
        parts.append(f"SELECT '{name}_schema_columns_present' AS check_name, count(*) AS failed_rows FROM (VALUES {wanted}) c(c) "
                     f"WHERE c NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM {views[table]}))")
    return v.sql(f"SELECT check_name, CASE WHEN failed_rows = 0 THEN 'passed' ELSE 'failed' END AS status, failed_rows FROM ({' UNION ALL '.join(parts)})",
                 *sorted({views[t] for _, t, _ in q_ops.REQUIRED_COLUMNS}))


REPORT_PARTS = ("quality_silver_rules", "quality_mart_contracts", "quality_unique_keys", "quality_foreign_keys", "quality_schema_presence", "quality_live_sanity", "quality_minimum_support")
SQL["quality_schema_presence"] = _schema_sql()
_REPORT = " UNION ALL ".join(f"SELECT check_name, status, failed_rows FROM ({text})" for text in (*[SQL[p] for p in REPORT_PARTS], files.SQL["quality_file_integrity"]))
SQL["quality_full_report"] = _REPORT
SQL["quality_roll_up"] = f"""SELECT CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'passed_with_warnings' ELSE 'passed' END AS status, count(*) AS checks FROM ({_REPORT})"""
SQL["quality_status_counts"] = f"SELECT status, count(*) AS checks FROM ({_REPORT}) GROUP BY 1"
QUERIES.update({name: _text_query(name) for name in SQL_TEXTS})
SQL.update({name: v.sql(text, view) for name, (view, text) in SQL_TEXTS.items()})
