"""Rank tests, paired tests and enrichment with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrastry.functions.expr import rounded
from contrastry.functions.ordered import bh_q_values, spearman
from contrastry.operators import contrasts as c_ops
from contrastry.operators import statistics as ops
from contrastry.plans import gold_contrasts as gc
from contrastry.plans import views as v
from contrastry.plans.warehouse import mart

v.SQL_VIEWS["native_arms"] = (("tumour", "mapped_reference"), """
    SELECT project_id AS cancer_type, gene_symbol, expression_value AS v, true AS t FROM tumour WHERE sample_type = 'Primary Tumor'
    UNION ALL SELECT cancer_type, gene_symbol, expression_value, false FROM mapped_reference""")
v.SQL_VIEWS["reprocessed_arms"] = (("reprocessed", "mapped_reprocessed"), """
    SELECT project_id AS cancer_type, gene_symbol, expression_value AS v, true AS t FROM reprocessed WHERE source = 'TCGA'
    UNION ALL SELECT cancer_type, gene_symbol, expression_value, false FROM mapped_reprocessed""")


def _test_sql(arms: str, prefix: str) -> str:
    z = "(greatest(0, greatest(u, nt * nn - u) - nt * nn / 2.0::DOUBLE - 0.5) / sd)"
    x = "(z / sqrt(2.0::DOUBLE))"
    tested = f"""(SELECT *, CASE WHEN sd > 0 THEN greatest(least(1, {v.sql_erfc(x)}), 1e-300) ELSE 1 END AS p FROM (
        SELECT *, CASE WHEN sd > 0 THEN {z} END AS z FROM (
          SELECT *, sqrt(nt * nn / 12.0::DOUBLE * (nt + nn + 1.0::DOUBLE - ties / ((nt + nn) * (nt + nn - 1.0::DOUBLE)))) AS sd FROM (
            SELECT cancer_type, gene_symbol, count(*) FILTER (t) AS nt, count(*) FILTER (NOT t) AS nn,
                   sum(r) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2.0::DOUBLE AS u,
                   sum((m * m - 1.0::DOUBLE)) AS ties, median(v) FILTER (t) AS mt, median(v) FILTER (NOT t) AS mn
            FROM (SELECT *, {v.sql_midrank('v', 'cancer_type, gene_symbol')} AS r,
                         count(*) OVER (PARTITION BY cancer_type, gene_symbol, v)::DOUBLE AS m FROM {arms})
            GROUP BY 1, 2) WHERE nt >= 5 AND nn >= 5)))"""
    return f"""SELECT cancer_type, gene_symbol, nt AS {prefix}_sample_count_tumor, nn AS {prefix}_sample_count_normal,
        mt AS {prefix}_median_tumor, mn AS {prefix}_median_normal, log2(mt + 1) - log2(mn + 1) AS {prefix}_log2_fold_change,
        u AS {prefix}_mann_whitney_u, p AS {prefix}_p_value, q AS {prefix}_fdr_q_value, 2 * u / (nt * nn) - 1 AS {prefix}_rank_biserial
        FROM ({v.sql_bh(tested, 'cancer_type', 'p', 'q')})"""


v.SQL_VIEWS["native_tests"] = (("native_arms",), _test_sql("native_arms", "native"))
v.SQL_VIEWS["reprocessed_tests"] = (("reprocessed_arms",), _test_sql("reprocessed_arms", "recount3"))


def _sig(p: str) -> str:
    return f"({p}_fdr_q_value <= 0.05 AND abs({p}_rank_biserial) >= 0.3)"


def _score(p: str) -> str:
    return f"(least(1, greatest(0, -log10(greatest({p}_fdr_q_value, 1e-300)) / 10)) * 0.6::DOUBLE + least(1, abs({p}_rank_biserial) / 0.5) * 0.4::DOUBLE)"


v.SQL_VIEWS["support"] = (("native_tests", "reprocessed_tests"), f"""
    SELECT *, CASE WHEN same THEN 'concordant' ELSE 'discordant' END AS effect_direction_agreement,
           CASE WHEN same THEN ({_score('native')} + {_score('recount3')}) / 2 ELSE 0 END AS statistical_support_score,
           CASE WHEN NOT same AND {_sig('native')} AND {_sig('recount3')} THEN 'discordant'
                WHEN same AND {_sig('native')} AND {_sig('recount3')} THEN 'replicated_fdr'
                WHEN same AND {_sig('recount3')} THEN 'recount3_fdr_supported'
                WHEN {_sig('native')} THEN 'native_only_fdr' ELSE 'limited' END AS statistical_support_tier,
           '{ops.STATISTICAL_CAVEAT}' AS statistical_caveat
    FROM (SELECT *, (native_rank_biserial > 0) = (recount3_rank_biserial > 0) AS same
          FROM native_tests JOIN reprocessed_tests USING (cancer_type, gene_symbol))""")

_X = "(abs(z) / sqrt(2.0::DOUBLE))"
_PAIRED_TESTED = f"""(SELECT *, CASE WHEN widest > 1e-8 AND z IS NOT NULL THEN greatest(least(1, {v.sql_erfc(_X)}), 1e-300) ELSE 1 END AS p FROM (
      SELECT *, CASE WHEN m > 0 THEN (least(plus, minus) - m * (m + 1) / 4.0::DOUBLE) / nullif(sqrt((m * (m + 1.0::DOUBLE) * (2.0::DOUBLE * m + 1) - ties / 2) / 24.0::DOUBLE), 0) END AS z
      FROM (SELECT cancer_type, gene_symbol, count(*) AS cases, median(t) AS mt, median(n) AS mn, median(d) AS md, max(abs(d)) AS widest FROM pairs
            GROUP BY 1, 2 HAVING count(*) >= 10)
      LEFT JOIN (SELECT cancer_type, gene_symbol, count(*) AS m, coalesce(sum(r) FILTER (d > 0), 0) AS plus, coalesce(sum(r) FILTER (d < 0), 0) AS minus,
                        sum(k * k - 1.0::DOUBLE) AS ties
                 FROM (SELECT *, {v.sql_midrank('abs(d)', 'cancer_type, gene_symbol')} AS r,
                              count(*) OVER (PARTITION BY cancer_type, gene_symbol, abs(d))::DOUBLE AS k FROM pairs WHERE d <> 0)
                 GROUP BY 1, 2) USING (cancer_type, gene_symbol)))"""

v.SQL_VIEWS["pairs"] = (("tumour",), """
    SELECT *, log2(t + 1) - log2(n + 1) AS d FROM (
      SELECT project_id AS cancer_type, gene_symbol, case_id, median(expression_value) FILTER (sample_type = 'Primary Tumor') AS t,
             median(expression_value) FILTER (sample_type = 'Solid Tissue Normal') AS n
      FROM tumour GROUP BY 1, 2, 3) WHERE t IS NOT NULL AND n IS NOT NULL""")
v.SQL_VIEWS["paired_tests"] = (("pairs",), f"""
    SELECT cancer_type, gene_symbol, cases AS matched_case_count, mt AS paired_median_tumor, mn AS paired_median_normal,
           md AS paired_median_log2_difference, CASE WHEN widest > 1e-8 THEN least(plus, minus) ELSE 0 END AS paired_wilcoxon_statistic,
           p AS paired_p_value, paired_fdr_q_value, coalesce((plus - minus) / nullif(plus + minus, 0), 0) AS paired_rank_biserial
    FROM ({v.sql_bh(_PAIRED_TESTED, 'cancer_type', 'p', 'paired_fdr_q_value')})""")
_PAIRED_SCORE = (
    "(least(1, greatest(0, -log10(greatest(paired_fdr_q_value, 1e-300)) / 10)) * 0.5::DOUBLE + least(1, abs(paired_rank_biserial) / 0.5) * 0.3::DOUBLE "
    "+ least(1, matched_case_count / 40.0::DOUBLE) * 0.2::DOUBLE)"
)
v.SQL_VIEWS["paired_support"] = (("paired_tests", "support"), f"""
    SELECT * EXCLUDE (same), CASE WHEN same THEN 'concordant' ELSE 'discordant' END AS paired_external_direction_agreement,
           CASE WHEN paired_support_tier = 'paired_discordant' THEN 0 ELSE {_PAIRED_SCORE} END AS paired_support_score,
           '{ops.PAIRED_CAVEAT}' AS paired_caveat
    FROM (SELECT *, CASE WHEN {_sig('paired')} AND {_sig('recount3')} AND NOT same THEN 'paired_discordant'
                         WHEN {_sig('paired')} AND {_sig('recount3')} THEN 'paired_replicated'
                         WHEN {_sig('paired')} THEN 'paired_internal_fdr' ELSE 'limited' END AS paired_support_tier
          FROM (SELECT *, (paired_rank_biserial > 0) = (recount3_rank_biserial > 0) AS same
                FROM (SELECT p.*, coalesce(s.recount3_fdr_q_value, 1) AS recount3_fdr_q_value, coalesce(s.recount3_rank_biserial, 0) AS recount3_rank_biserial
                      FROM paired_tests p LEFT JOIN support s ON p.cancer_type = s.cancer_type AND p.gene_symbol = s.gene_symbol)))""")

# Candidate decisions for the enrichment: the contrast's fold change cut into the decision labels.
v.SQL_VIEWS["decisions"] = (("contrast",), """
    SELECT cancer_type, gene_symbol,
           CASE WHEN log2_fold_change >= 0.2 THEN 'prioritized' WHEN log2_fold_change >= 0.05 THEN 'watchlist' ELSE 'deprioritized' END AS consensus_decision,
           CASE WHEN log2_fold_change >= 0.3 THEN 'strong_candidate' WHEN log2_fold_change >= 0.1 THEN 'research_candidate' ELSE 'exploratory' END AS publication_tier
    FROM contrast""")

_LF = lambda n: f"lgamma(({n}) + 1.0::DOUBLE)"
_TERM = (
    f"exp({_LF('m')} - {_LF('i')} - {_LF('m - i')} + {_LF('bg - m')} - {_LF('n - i')} - {_LF('bg - m - n + i')} "
    f"- {_LF('bg')} + {_LF('n')} + {_LF('bg - n')})"
)
v.SQL_VIEWS["candidate_members"] = (("decisions",), """
    SELECT cancer_type, 'prioritized' AS candidate_set, gene_symbol FROM decisions WHERE consensus_decision = 'prioritized'
    UNION ALL SELECT cancer_type, 'watchlist_plus_prioritized', gene_symbol FROM decisions WHERE consensus_decision IN ('prioritized', 'watchlist')
    UNION ALL SELECT cancer_type, 'research_candidate_plus', gene_symbol FROM decisions WHERE publication_tier IN ('strong_candidate', 'research_candidate')""")
v.SQL_VIEWS["enrichment_family"] = (("decisions", "candidate_members", "gene_sets"), f"""
    SELECT *, CASE WHEN k <= greatest(0, n + m - bg) THEN 1 ELSE
        greatest(1e-300, least(1, (SELECT sum({_TERM}) FROM range(k, least(n, m) + 1) r(i)))) END AS p
    FROM (SELECT s.cancer_type, d.candidate_set, s.pathway_id, s.pathway_name, s.pathway_source, bg, n, m, coalesce(k, 0) AS k, coalesce(genes, '') AS overlap_genes
          FROM (SELECT b.cancer_type, pathway_id, pathway_name, pathway_source, count(*) AS m FROM gene_sets g JOIN decisions b USING (gene_symbol)
                GROUP BY 1, 2, 3, 4 HAVING count(*) BETWEEN 5 AND 500) s
          JOIN (SELECT cancer_type, candidate_set, count(*) AS n FROM candidate_members GROUP BY 1, 2) d ON s.cancer_type = d.cancer_type
          JOIN (SELECT cancer_type, count(*) AS bg FROM decisions GROUP BY 1) b ON s.cancer_type = b.cancer_type
          LEFT JOIN (SELECT cancer_type, candidate_set, pathway_id, count(*) AS k, string_agg(gene_symbol, ',' ORDER BY gene_symbol) AS genes
                     FROM gene_sets JOIN candidate_members USING (gene_symbol) GROUP BY 1, 2, 3) o
            ON o.cancer_type = s.cancer_type AND o.candidate_set = d.candidate_set AND o.pathway_id = s.pathway_id)""")
v.SQL_VIEWS["enrichment"] = (("enrichment_family",), f"""
    SELECT *, round(least(1, greatest(0, -log10(greatest(fdr_q_value, 1e-300)) / 10)) * 0.55::DOUBLE + least(1, overlap_gene_count / 10.0::DOUBLE) * 0.25::DOUBLE
                    + least(1, enrichment_ratio / 5) * 0.2::DOUBLE, 6) AS enrichment_score,
           CASE WHEN fdr_q_value <= 0.05 AND overlap_gene_count >= 3 THEN 'fdr_enriched' WHEN p_value <= 0.05 THEN 'nominal' ELSE 'limited' END AS enrichment_tier,
           '{ops.ENRICHMENT_CAVEAT}' AS pathway_caveat
    FROM (SELECT cancer_type, candidate_set, pathway_id, pathway_name, pathway_source, bg AS background_gene_count, n AS candidate_gene_count,
                 m AS pathway_gene_count, k AS overlap_gene_count, overlap_genes, k / (n * m / bg) AS enrichment_ratio,
                 CASE WHEN m - k <= 0 OR n - k <= 0 THEN CASE WHEN k > 0 AND bg - m - n + k >= 0 THEN 'inf'::DOUBLE ELSE 0 END
                      ELSE k * (bg - m - n + k) / ((m - k) * (n - k)) END AS odds_ratio,
                 p AS p_value, fdr_q_value
          FROM ({v.sql_bh('enrichment_family', 'cancer_type, candidate_set', 'p', 'fdr_q_value')}))
    WHERE overlap_gene_count >= 2""")


@mart("mart_native_tests")
def native_tests(spark, d):
    return ops.mann_whitney(ops.native_arms(v.tumour(spark, d), v.reference(spark, d), v.cohorts(spark)), "native")


@mart("mart_reprocessed_tests")
def reprocessed_tests(spark, d):
    return ops.mann_whitney(ops.reprocessed_arms(v.reprocessed(spark, d), v.cohorts(spark)), "recount3")


@mart("mart_statistics")
def support(spark, d):
    return ops.statistical_support(native_tests(spark, d), reprocessed_tests(spark, d))


@mart("mart_paired_tests")
def paired_tests(spark, d):
    return ops.paired_wilcoxon(v.tumour(spark, d))


@mart("mart_paired")
def paired(spark, d):
    return ops.paired_support(paired_tests(spark, d), support(spark, d))


@mart("mart_decisions")
def decisions(spark, d):
    fc = F.col("log2_fold_change")
    return gc.contrast(spark, d).select(
        "cancer_type", "gene_symbol",
        F.when(fc >= 0.2, "prioritized").when(fc >= 0.05, "watchlist").otherwise("deprioritized").alias("consensus_decision"),
        F.when(fc >= 0.3, "strong_candidate").when(fc >= 0.1, "research_candidate").otherwise("exploratory").alias("publication_tier"),
    )


@mart("mart_enrichment")
def enrichment(spark, d):
    return ops.set_enrichment(decisions(spark, d), v.gene_sets(spark, d))


def q_values(spark, d):
    """BH over event values read as p-values, one family per event type."""
    events = v.table(spark, d, "events").select("event_id", "event_type", (F.col("value") / 1000.0).alias("p"))
    return bh_q_values(events, ["event_type"], "p", "q").select("event_id", F.round("q", 6).alias("q"))


def correlation(spark, d):
    lines = v.table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(spearman(lines, ["l_returnflag"], "l_quantity", "l_extendedprice", "rho"))


def effects(spark, d):
    rows = ops.native_arms(v.tumour(spark, d), v.reference(spark, d), v.cohorts(spark))
    return rounded(ops.rank_biserial(rows, c_ops.KEYS))


TEST_DOUBLES = "{p}_median_tumor {p}_median_normal {p}_log2_fold_change {p}_mann_whitney_u {p}_p_value {p}_fdr_q_value {p}_rank_biserial"
PAIRED_DOUBLES = "paired_median_tumor paired_median_normal paired_median_log2_difference paired_wilcoxon_statistic paired_p_value paired_fdr_q_value paired_rank_biserial"
SUPPORT_DOUBLES = TEST_DOUBLES.format(p="native") + " " + TEST_DOUBLES.format(p="recount3") + " statistical_support_score"
ENRICHMENT_DOUBLES = "enrichment_ratio odds_ratio p_value fdr_q_value enrichment_score"

QUERIES = {
    "benjamini_hochberg_q_values": q_values,
    "spearman_correlation": correlation,
    "rank_biserial_effect": effects,
    "mann_whitney_native": lambda s, d: rounded(native_tests.fresh(s, d)),
    "mann_whitney_reprocessed": lambda s, d: rounded(reprocessed_tests.fresh(s, d)),
    "expression_statistical_support": lambda s, d: rounded(support.fresh(s, d)),
    "paired_wilcoxon": lambda s, d: rounded(paired_tests.fresh(s, d)),
    "paired_expression_support": lambda s, d: rounded(paired.fresh(s, d)),
    "candidate_gene_sets": lambda s, d: ops.candidate_sets(decisions(s, d)),
    "pathway_enrichment": lambda s, d: rounded(enrichment.fresh(s, d)),
}

SQL = {
    "benjamini_hochberg_q_values": "SELECT event_id, round(q, 6) AS q FROM ("
    + v.sql_bh("(SELECT event_id, event_type, least(greatest(value / 1000.0::DOUBLE, 0), 1) AS p FROM events)", "event_type", "p", "q") + ")",
    "spearman_correlation": f"""SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM (
        SELECT l_returnflag, {v.sql_midrank('l_quantity', 'l_returnflag')} AS a, {v.sql_midrank('l_extendedprice', 'l_returnflag')} AS b FROM lineitem) GROUP BY 1""",
    "rank_biserial_effect": v.sql(f"""SELECT cancer_type, gene_symbol, round(2 * (sum(r) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER (t) * count(*) FILTER (NOT t)) - 1, 6) AS effect
        FROM (SELECT *, {v.sql_midrank('v', 'cancer_type, gene_symbol')} AS r FROM native_arms) GROUP BY 1, 2""", "native_arms"),
    "mann_whitney_native": v.sql(v.rounds(TEST_DOUBLES.format(p="native"), "native_tests"), "native_tests"),
    "mann_whitney_reprocessed": v.sql(v.rounds(TEST_DOUBLES.format(p="recount3"), "reprocessed_tests"), "reprocessed_tests"),
    "expression_statistical_support": v.sql(
        v.rounds(SUPPORT_DOUBLES, "(SELECT * EXCLUDE (same) FROM support)"), "support"),
    "paired_wilcoxon": v.sql(v.rounds(PAIRED_DOUBLES, "paired_tests"), "paired_tests"),
    "paired_expression_support": v.sql(
        v.rounds(PAIRED_DOUBLES + " recount3_fdr_q_value recount3_rank_biserial paired_support_score", "paired_support"), "paired_support"),
    "candidate_gene_sets": v.sql("SELECT * FROM candidate_members", "candidate_members"),
    "pathway_enrichment": v.sql(v.rounds(ENRICHMENT_DOUBLES, "enrichment"), "enrichment"),
}
