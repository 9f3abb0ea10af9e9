"""Mutation marts, scores and graph on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from contrastry.operators import graph as g_ops
from contrastry.operators import mutations as m_ops
from contrastry.operators import scores as s_ops

MUTATION = ("project_id string, sample_id string, gene_symbol string, variant_classification string, is_protein_altering boolean, reference_assembly string, "
            "chromosome string, start_position long, reference_allele string, tumor_seq_allele string")
PROFILE = "project_id string, sample_id string"


def _mut(spark, rows):
    return spark.createDataFrame([("LUAD", *r) for r in rows], MUTATION)


def test_frequency_counts_and_zero_event_cohort(spark):
    m = _mut(spark, [("s1", "TP53", "Missense_Mutation", True, "GRCh38", "1", 5, "A", "T"), ("s1", "TP53", "Silent", False, "GRCh38", "1", 5, "A", "T"), ("s2", "TP53", "Silent", False, "GRCh38", "1", 6, "A", "T")])
    profile = spark.createDataFrame([("LUAD", f"s{i}") for i in (1, 2, 3)] + [("COAD", "x")], PROFILE)
    (gene,) = m_ops.frequency_by_gene(m, profile).collect()
    assert gene.mutation_frequency == pytest.approx(1 / 3)
    assert (gene.protein_altering_event_count, gene.synonymous_event_count, gene.all_somatic_event_count) == (1, 2, 3)
    assert gene.top_variant_classification == "Missense_Mutation"
    cancers = {r.cancer_type: r for r in m_ops.frequency_by_cancer(m, profile).collect()}
    assert cancers["COAD"].mutation_frequency == 0.0 and cancers["COAD"].mutation_event_count == 0
    assert cancers["LUAD"].mutation_event_rate == pytest.approx(1 / 3)


def test_modal_class_ties_break_by_name(spark):
    m = _mut(spark, [("s1", "G", "Splice_Site", True, "x", "1", 1, "A", "T"), ("s2", "G", "Frame_Shift_Del", True, "x", "1", 2, "A", "T")])
    assert m_ops.frequency_by_gene(m, m).first().top_variant_classification == "Frame_Shift_Del"


def test_functional_evidence_and_recurrence(spark):
    rows = [
        ("s1", "TP53", "Missense_Mutation", True, "GRCh38", "17", 10, "A", "T"), ("s2", "TP53", "Missense_Mutation", True, "GRCh38", "17", 10, "A", "T"),
        ("s3", "TP53", "Nonsense_Mutation", True, "GRCh38", "17", 20, "A", "T"), ("s4", "TP53", "In_Frame_Del", True, "GRCh38", "17", 30, "A", "T"),
        ("s1", "EGFR", "Missense_Mutation", True, "GRCh38", "7", 1, "A", "T"), ("s5", "TP53", "Silent", False, "GRCh38", "17", 10, "A", "T"),
    ]
    profile = spark.createDataFrame([("LUAD", f"s{i}") for i in range(1, 7)], PROFILE)
    got = {r.gene_symbol: r for r in m_ops.functional_evidence(_mut(spark, rows), profile).collect()}
    tp53 = got["TP53"]
    assert (tp53.protein_altering_mutated_sample_count, tp53.putative_loss_of_function_sample_count, tp53.missense_sample_count, tp53.inframe_sample_count) == (4, 1, 2, 1)
    assert (tp53.recurrent_locus_count, tp53.recurrent_locus_sample_fraction) == (1, pytest.approx(2 / 6))
    assert got["EGFR"].recurrent_locus_count == 0
    with pytest.raises(ValueError):
        m_ops.functional_evidence(_mut(spark, rows), profile, recurrence_threshold=1)


@pytest.mark.parametrize("assemblies", [("Unknown", "Unknown"), ("GRCh37", "GRCh38")])
def test_no_recurrence_without_one_known_assembly(spark, assemblies):
    rows = [(f"s{i}", "TP53", "Missense_Mutation", True, a, "17", 10, "A", "T") for i, a in enumerate(assemblies)]
    row = m_ops.functional_evidence(_mut(spark, rows), _mut(spark, rows)).first()
    assert row.recurrent_locus_count == 0 and row.max_locus_sample_count == 0


def test_transcript_evidence_normalises_annotations(spark):
    cols = "project_id string, sample_id string, gene_symbol string, transcript_id string, vep_consequence string, vep_impact string, variant_classification string, hgvsc string, hgvsp string, all_effects string"
    m = spark.createDataFrame([("LUAD", "s1", "TP53", " T1", "missense", "high", "M", "c.1", "p.1", ""), ("LUAD", "s1", "TP53", "T1 ", "missense", " HIGH", "M", " ", "p.2", None),
                               ("LUAD", "s2", "TP53", "T1", "missense", "High", "M", None, " ", "x"), ("LUAD", "s2", " ", "T1", "missense", "High", "M", None, " ", "x")], cols)
    profile = spark.createDataFrame([("LUAD", f"s{i}") for i in (1, 2, 3)], PROFILE)
    (row,) = m_ops.transcript_evidence(m, profile).collect()
    assert (row.event_count, row.distinct_sample_count, row.sample_fraction) == (3, 2, pytest.approx(2 / 3))
    assert (row.hgvsc_annotation_event_count, row.hgvsp_annotation_event_count, row.all_effects_annotation_event_count) == (1, 2, 1)


def test_variant_classes(spark):
    got = {r[0]: r[1:] for r in m_ops.classify(spark.createDataFrame([(c,) for c in ("missense mutation ", "Silent", "Intron", "Start_Codon_SNP", "odd", None)], "variant_classification string")).collect()}
    assert got["missense mutation "] == ("protein_altering", True, "missense")
    assert got["Silent"] == ("synonymous", False, "not_protein_altering") and got["Intron"][0] == "non_coding_or_regulatory"
    assert got["Start_Codon_SNP"] == ("protein_altering", True, "other_protein_altering") and got["odd"][0] == got[None][0] == "unclassified"


def _priority(spark):
    mut = spark.createDataFrame([("BRCA", "TP53", 0.5, 5, 10), ("BRCA", "MUT", 0.1, 1, 10)], "cancer_type string, gene_symbol string, mutation_frequency double, mutated_sample_count long, total_profiled_sample_count long")
    con = spark.createDataFrame([("BRCA", "TP53", 2.0, 40, 40), ("BRCA", "EXP", -1.0, 40, 20)], "cancer_type string, gene_symbol string, log2_fold_change double, sample_count_tumor long, sample_count_normal long")
    return s_ops.candidate_priority(mut, con), con


def test_priority_blends_both_kinds_of_evidence(spark):
    got = {r.gene_symbol: r for r in _priority(spark)[0].collect()}
    assert got["TP53"].evidence_count == 2 and got["TP53"].priority_score == pytest.approx(0.5 * 0.65 + 0.25 + 0.1) and got["TP53"].priority_tier == "high"
    assert got["EXP"].priority_score == pytest.approx(0.125 + 0.05) and got["EXP"].priority_tier == "low"
    assert got["MUT"].evidence_summary == "mutation_frequency=0.1;abs_log2_fold_change=0.0"


def test_confidence_tiers_caveats_and_calibration(spark, cohorts):
    candidates, con = _priority(spark)
    batch = spark.createDataFrame([("BRCA", "TP53", "rank_up", "high", 0.5, 2.0), ("BRCA", "EXP", "rank_up", "limited", 0.5, 2.0)],
                                  "cancer_type string, gene_symbol string, sensitivity_direction string, support_tier string, percentile_delta double, robust_z_delta double")
    metrics = spark.createDataFrame([("Gene", "TP53", 5)], "node_label string, name string, total_degree long")
    edges = spark.createDataFrame([("MUTATED_IN_CANCER", "GENE:TP53", "BRCA")], "edge_type string, source_node_id string, target_node_id string")
    mutations = spark.createDataFrame([("BRCA", "TP53", "public/maf"), ("BRCA", "MUT", "stub")], "project_id string, gene_symbol string, data_origin string")
    tumour = spark.createDataFrame([("BRCA", "TP53", "public/star"), ("BRCA", "EXP", "demo")], "project_id string, gene_symbol string, data_origin string")
    from contrastry.functions.domain import cohort_map
    reference = spark.createDataFrame([("Breast", "TP53", "public/star")], "tissue_site string, gene_symbol string, data_origin string")
    out = s_ops.evidence_confidence(candidates, con, batch, metrics, edges, mutations, tumour, reference, cohort_map(spark, [("BRCA", "Breast")]))
    got = {r.gene_symbol: r for r in out.collect()}
    tp53 = got["TP53"]
    assert tp53.batch_concordance == "concordant" and tp53.batch_sensitivity_confidence == 1.0 and tp53.graph_confidence == 1.0 and tp53.traceability_confidence == 1.0
    bio = (0.55 * 0.1 + 0.45 * 0.25) * 0.6 + 0.5 * 0.4
    assert tp53.biological_confidence == pytest.approx(bio) and tp53.overall_confidence == pytest.approx(round(bio * 0.75 + 0.25, 6))
    assert tp53.caveat_summary == "cross_study_batch_effect_unadjusted;mutation_profiled_support_below_100"
    assert got["EXP"].batch_concordance == "discordant" and got["EXP"].batch_effect_risk == "high" and "graph_support_absent" in got["EXP"].caveat_summary
    assert got["MUT"].batch_concordance == "not_applicable" and got["MUT"].traceability_status == "failed"
    row = s_ops.confidence_calibration(out).first()
    assert row.candidate_count == 3 and row.high_count + row.moderate_count + row.limited_count + row.low_count == 3
    assert s_ops.calibration_status(out.limit(0)).first().status == "no_candidates"


def test_consensus_decisions(spark):
    key = "cancer_type string, gene_symbol string, "
    both = [("BRCA", "STRONG"), ("BRCA", "BADREF")]
    make = lambda cols, strong, bad: spark.createDataFrame([(*both[0], *strong), (*both[1], *bad)], key + cols)
    candidates = make("priority_score double, priority_tier string, mutation_frequency double, mutated_sample_count long, total_profiled_sample_count long, log2_fold_change double, abs_log2_fold_change double",
                      (0.95, "high", 0.9, 9, 10, 3.0, 3.0), (0.5, "high", 0.1, 1, 10, 3.0, 3.0))
    out = s_ops.consensus_candidates(
        candidates, make("overall_confidence double, confidence_tier string", (0.9, "high"), (0.2, "low")),
        make("reference_stability_score double, reference_concordance string", (1.0, "concordant_up"), (0.5, "discordant")),
        make("bootstrap_stability_score double, bootstrap_stability_tier string", (0.95, "high"), (0.3, "unstable")),
        make("validation_score double, validation_tier string, direction_agreement string", (0.95, "high", "concordant"), (0.2, "discordant", "discordant")),
        make("statistical_support_score double, statistical_support_tier string, native_fdr_q_value double, recount3_fdr_q_value double, native_rank_biserial double, recount3_rank_biserial double",
             (0.95, "replicated_fdr", 0.01, 0.01, 0.9, 0.9), (0.2, "limited", 0.5, 0.5, 0.1, 0.1)),
        make("matched_case_count long, paired_fdr_q_value double, paired_rank_biserial double, paired_support_score double, paired_support_tier string", (40, 0.01, 0.9, 0.95, "paired_replicated"), (12, 0.9, 0.0, 0.1, "limited")),
    )
    got = {r.gene_symbol: r for r in out.collect()}
    assert (got["STRONG"].consensus_decision, got["STRONG"].publication_tier, got["STRONG"].rejection_reasons) == ("prioritized", "strong_candidate", "none")
    assert got["BADREF"].consensus_decision == "deprioritized"
    assert got["BADREF"].rejection_reasons == "reprocessing_corroboration_discordant;reference_sensitive_or_discordant;bootstrap_support_weak;evidence_confidence_weak;low_consensus_score"
    sparse = s_ops.consensus_candidates(candidates, *[d.limit(0) for d in (
        make("overall_confidence double, confidence_tier string", (0.9, "high"), (0.2, "low")), make("reference_stability_score double, reference_concordance string", (1.0, "x"), (0.5, "y")),
        make("bootstrap_stability_score double, bootstrap_stability_tier string", (1.0, "x"), (0.5, "y")), make("validation_score double, validation_tier string, direction_agreement string", (1.0, "x", "z"), (0.5, "y", "z")),
        make("statistical_support_score double, statistical_support_tier string, native_fdr_q_value double, recount3_fdr_q_value double, native_rank_biserial double, recount3_rank_biserial double", (1.0, "x", 1.0, 1.0, 1.0, 1.0), (1.0, "x", 1.0, 1.0, 1.0, 1.0)),
        make("matched_case_count long, paired_fdr_q_value double, paired_rank_biserial double, paired_support_score double, paired_support_tier string", (1, 1.0, 1.0, 1.0, "x"), (1, 1.0, 1.0, 1.0, "x")))])
    row = sparse.where("gene_symbol = 'STRONG'").first()
    assert row.confidence_tier == "missing" and row.recount3_fdr_q_value == 1.0 and row.evidence_component_count == 2


def _graph(spark):
    nodes = spark.createDataFrame([("BRCA", "CancerType", "BRCA", "Breast", "TCGA"), ("GENE:TP53", "Gene", "TP53", "Unknown", "TCGA"), ("SAMPLE:s1", "Sample", "s1", "BRCA", "TCGA")], ", ".join(f"{c} string" for c in g_ops.NODE))
    edges = spark.createDataFrame([("e1", "GENE:TP53", "BRCA", "MUTATED_IN_CANCER", 0.4, "TCGA"), ("e2", "SAMPLE:s1", "BRCA", "BELONGS_TO_CANCER", 1.0, "TCGA")],
                                  "edge_id string, source_node_id string, target_node_id string, edge_type string, weight double, evidence_source string")
    return nodes, edges


def test_public_filter_and_degrees(spark):
    nodes, edges = _graph(spark)
    audit = g_ops.public_audit(nodes, edges).first()
    assert (audit.excluded_nodes, audit.public_edges, audit.excluded_edges) == (1, 1, 1)
    got = {r.node_id: r for r in g_ops.node_metrics(g_ops.public_nodes(nodes), g_ops.public_edges(nodes, edges)).collect()}
    assert (got["BRCA"].in_degree, got["BRCA"].out_degree, got["BRCA"].weighted_degree) == (1, 0, 0.4)
    assert sorted(r.degree_rank for r in got.values()) == [1, 2] and got["BRCA"].degree_rank == 1


def test_degree_rank_order_with_many_leaves(spark):
    edges = spark.createDataFrame([(f"e{i}", f"GENE:{i:05d}", "HUB" if i % 2 else f"T{i % 7}", "X", float(i % 3), "s") for i in range(600)],
                                  "edge_id string, source_node_id string, target_node_id string, edge_type string, weight double, evidence_source string")
    ids = [f"GENE:{i:05d}" for i in range(600)] + ["HUB"] + [f"T{i}" for i in range(7)] + ["LONE"]
    nodes = spark.createDataFrame([(i, "Gene", i, "u", "s") for i in ids], ", ".join(f"{c} string" for c in g_ops.NODE))
    rows = g_ops.node_metrics(nodes, edges).orderBy("degree_rank").collect()
    want = sorted(rows, key=lambda r: (-r.total_degree, -r.weighted_degree, r.node_id))
    assert [r.node_id for r in rows] == [r.node_id for r in want] and [r.degree_rank for r in rows] == list(range(1, len(ids) + 1))
    assert rows[0].node_id == "HUB" and rows[-1].node_id == "LONE"


def test_node_build_merges_gene_sources_and_edges_are_unique(spark):
    one = lambda rows, cols: spark.createDataFrame(rows, cols)
    projects = one([("BRCA", "Breast")], "project_id string, primary_site string")
    samples = one([("BRCA", "c1", "s1"), ("BRCA", "c1", "s1")], "project_id string, case_id string, sample_id string")
    genes, ref = one([("TP53",), ("",)], "gene_symbol string"), one([("TP53", "Breast"), ("ESR1", "Breast")], "gene_symbol string, tissue_site string")
    pathways, members = one([("P1", "Cycle", "Reactome")], "pathway_id string, pathway_name string, pathway_source string"), one([("TP53",)], "gene_symbol string")
    nodes = {r.node_id: r for r in g_ops.graph_nodes(projects, samples, samples, genes, ref, pathways, members).collect()}
    assert nodes["GENE:TP53"].source == "GTEx/Reactome/TCGA" and nodes["GENE:ESR1"].source == "GTEx" and len({r.node_label for r in nodes.values()}) == 7
    assert g_ops.union_edges(g_ops.sample_edges(samples), g_ops.cancer_edges(samples)).count() == 2


def test_pathway_selection_dedupes_and_caps(spark):
    cols = "cancer_type string, pathway_id string, candidate_set string, fdr_q_value double, enrichment_score double, overlap_gene_count long, enrichment_tier string"
    rows = [("BRCA", "P1", "a", 0.01, 0.5, 3, "fdr_enriched"), ("BRCA", "P1", "b", 0.01, 0.6, 3, "fdr_enriched"), ("BRCA", "P2", "a", 0.02, 0.5, 3, "fdr_enriched"),
            ("BRCA", "P3", "a", 0.03, 0.5, 3, "fdr_enriched"), ("BRCA", "P4", "a", 0.001, 0.5, 3, "nominal")]
    got = g_ops.select_pathways(spark.createDataFrame(rows, cols), max_per_cancer=2).collect()
    assert sorted((r.pathway_id, r.candidate_set) for r in got) == [("P1", "b"), ("P2", "a")]
    sets = spark.createDataFrame([("P1", "x", "R", "G1"), ("P1", "x", "R", "G1"), ("P9", "x", "R", "G1")], "pathway_id string, pathway_name string, pathway_source string, gene_symbol string")
    assert g_ops.selected_memberships(spark.createDataFrame(rows, cols).limit(1), sets).count() == 1


def test_neighbourhood_has_no_dangling_nodes(spark):
    nodes, edges = _graph(spark)
    near = g_ops.neighbourhood_edges(nodes, edges, node_query="tp53")
    assert [r.edge_id for r in near.collect()] == ["e1"]
    assert {r.node_id for r in g_ops.induced_nodes(nodes, near).collect()} == {"BRCA", "GENE:TP53"}
    assert g_ops.neighbourhood_edges(nodes, edges, node_query="absent").count() == 0


def test_tables_of_measurements_share_one_join(spark):
    from contrastry.plans import views as v

    d = "/root/testdata/sf0.001"
    tables = [t.fresh(spark, d) for t in (v.tumour, v.reference, v.reprocessed)]
    for df in tables:
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert tables[0].count() + tables[1].count() == spark.read.parquet(f"{d}/lineitem.parquet").count()


def test_schema_presence_builds_no_mart(spark):
    from contrastry.plans import reads, warehouse

    before = set(warehouse._STORED)
    rows = reads.schema_checks(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 21 and "gold_graph_edges_schema_columns_present" in {r.check_name for r in rows if r.status == "passed"}
    assert set(warehouse._STORED) == before


def test_planned_tables_have_the_columns_of_the_written_ones(spark):
    from contrastry.plans import gold_contrasts as gc
    from contrastry.session import schemas_only

    d = "/root/testdata/sf0.001/"  # a key of its own: nothing is stored for it elsewhere
    with schemas_only():
        planned = gc.validation(spark, d)
        assert planned.count() == 0
    assert planned.columns == gc.validation(spark, d).columns


def test_contrast_and_triangulation_share_the_profiled_arms(spark):
    from contrastry.plans import gold_contrasts as gc
    from contrastry.plans import warehouse

    d = "/root/testdata/sf0.001"
    for mart in (gc.contrast, gc.triangulation):
        kept, afresh = (df.orderBy("cancer_type", "gene_symbol").collect() for df in (mart(spark, d), mart.fresh(spark, d)))
        assert [r.gene_symbol for r in kept] == [r.gene_symbol for r in afresh] and len(kept) > 0
        for a, b in zip(kept, afresh):
            assert all(x == pytest.approx(y) for x, y in zip(a, b))
    assert {"arm_profiles", "adjacent_profile"} <= {name for _, _, name in warehouse._STORED}


def test_dangling_edges_stay_one_row_each(spark):
    from contrastry.operators import quality as q_ops

    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "node_id string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "a", "x"), ("2", "y", "x"), ("3", "x", "b"), ("4", None, "a"), (None, "a", "z"), (None, "z", "a")],
                                  "edge_id string, source_node_id string, target_node_id string")
    found = q_ops.dangling_edges(nodes, edges)
    assert found.first().failed_rows == 4  # 2, 3, 4 and the edges without an id
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_public_graph_is_built_without_individuals(spark, tmp_path):
    from contrastry.plans import gold_evidence as ge
    from contrastry.plans import warehouse

    d = str(tmp_path / "tables")  # a name of its own, so that nothing is stored for it
    os.symlink("/root/testdata/sf0.001", d)
    assert ge.QUERIES["graph_neighbourhood_counts"](spark, d).count() > 0
    ge.metrics(spark, d).count()
    built = {name for _, folder, name in warehouse._STORED if folder == os.path.abspath(d)}
    assert "measurements" in built and not built & {"graph_nodes", "graph_edges", "samples", "patients", "tumour", "reference", "reprocessed"}
    nodes, edges = ge.nodes(spark, d), ge.edges(spark, d)
    whole = g_ops.public_edges(nodes, edges)
    assert whole.exceptAll(ge.public_edges(spark, d)).count() == 0 and ge.public_edges(spark, d).count() == whole.count() > 0
    assert g_ops.public_nodes(nodes).exceptAll(ge.public_nodes(spark, d)).count() == 0
    assert ge.public_nodes(spark, d).count() == g_ops.public_nodes(nodes).count() < nodes.count()


@pytest.mark.parametrize("renamed", [None, "PATIENT:X"])
def test_individuals_are_counted_without_the_whole_graph(spark, tmp_path, monkeypatch, renamed):
    from contrastry.operators import quality as q_ops
    from contrastry.plans import gold_evidence as ge
    from contrastry.plans import reads
    from contrastry.plans import views as v
    from contrastry.plans import warehouse

    source, d = "/root/testdata/sf0.001", str(tmp_path)
    for name in os.listdir(source):
        os.symlink(f"{source}/{name}", f"{d}/{name}")
    if renamed:  # a cohort that bears the name of an individual reaches the other families
        cohorts = tuple((e, renamed if c == "BUILDING" else c) for e, c in v.EVENT_COHORTS)
        monkeypatch.setattr(v, "EVENT_COHORTS", cohorts)
    got = reads.QUERIES["quality_individual_leaks"](spark, d).first()
    assert warehouse.held(spark, d, "graph_edges") == bool(renamed) and warehouse.held(spark, d, "graph_nodes") == bool(renamed)
    assert got == q_ops.individual_leaks(ge.nodes(spark, d), ge.edges(spark, d)).first() and min(got) > 0
    if renamed:
        assert ge.edges(spark, d).where(f"edge_type = 'MUTATED_IN_CANCER' AND target_node_id = '{renamed}'").count() > 0
