"""Bootstrap, consensus, ablation, partitions, rankings and pipeline agreement, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrastry.functions.expr import rounded
from contrastry.functions.ordered import unit_medians
from contrastry.operators import agreement as a_ops
from contrastry.operators import resampling as r_ops
from contrastry.operators import scores as s_ops
from contrastry.plans import gold_contrasts as gc
from contrastry.plans import gold_evidence as ge
from contrastry.plans import gold_statistics as gs
from contrastry.plans import views as v
from contrastry.plans.warehouse import mart

SEED, RUNS, TOP_K, TIE_DRAWS = 20, 20, (5, 10), 10


# ---------------------------------------------------------------- complete gene x sample tables

#: Table: fewest units, and customers that share a unit beyond them. A unit must hold enough of them to measure every gene.
UNIT_SHARES = {"dense": (16, 93), "panel": (6, 500)}


def unit_count(s, d, table: str) -> int:
    fewest, share = UNIT_SHARES[table]
    return max(fewest, v.table(s, d, "customer").count() // share)


def _unit_count_sql(table: str) -> str:
    fewest, share = UNIT_SHARES[table]
    return f"(SELECT greatest({fewest}, count(*) // {share}) FROM customer)"


def _grid(s, d, gene: str, table: str):
    """Median value per (cohort, gene, arm, unit); the units grow with the customers."""
    unit = F.concat(F.lit("U"), F.pmod(F.substring("case_id", 2, 20).cast("long"), F.lit(unit_count(s, d, table))))
    arms = F.create_map(*[F.lit(x) for x in ("A", "t", "R", "a", "N", "n")])
    symbol = F.col("gene_symbol") if gene == "product" else F.substring_index("gene_symbol", "_", 1)
    rows = v.measurements(s, d).select(
        F.col("cohort").alias("cancer_type"), symbol.alias("gene_symbol"), arms[F.col("arm")].alias("_arm"), unit.alias("unit_id"), "value", "alt_value"
    )
    keys = ["cancer_type", "gene_symbol", "_arm", "unit_id"]
    medians = unit_medians(rows, keys, {"native_value": "value", "recount_value": "alt_value"})
    sample = F.concat("_arm", F.lit("-"), "unit_id")
    return medians.withColumn("sample_id", sample)


def _grid_sql(gene: str, table: str) -> str:
    return f"""SELECT *, _arm || '-' || unit_id AS sample_id FROM (
        SELECT cohort AS cancer_type, {gene} AS gene_symbol, CASE arm WHEN 'A' THEN 't' WHEN 'R' THEN 'a' ELSE 'n' END AS _arm,
               'U' || (CAST(substr(case_id, 2) AS BIGINT) % {_unit_count_sql(table)}) AS unit_id, median(value) AS native_value, median(alt_value) AS recount_value
        FROM measurements GROUP BY ALL)"""


v.SQL_VIEWS["dense"] = (("measurements",), _grid_sql("split_part(gene_symbol, '_', 1)", "dense"))
v.SQL_VIEWS["panel"] = (("measurements",), _grid_sql("gene_symbol", "panel"))


@mart("dense")
def dense(s, d):
    return _grid(s, d, "brand", "dense")


@mart("panel")
def panel(s, d):
    return _grid(s, d, "product", "panel")


def native_rows(df):
    return df.select("cancer_type", "gene_symbol", "_arm", "unit_id", F.col("sample_id").alias("_sample"), F.col("native_value").alias("_value"))


def sql_draws(units: str, pool: str, unit: str, seed: int, runs: int) -> str:
    """One row per drawn slot (repeated units repeat), plus replicate -1 with every unit once."""
    keys = ", ".join(pool.split())
    return f"""SELECT {keys}, replicate, {unit} FROM (
        SELECT {keys}, replicate, ('0x' || substr(md5(concat_ws('|', {seed}, {keys}, replicate, slot)), 1, 8))::BIGINT % n + 1 AS slot
        FROM ({_slots(units, keys, unit)}), range(0, {runs}) r(replicate)) JOIN ({_slots(units, keys, unit)}) USING ({keys}, slot)
      UNION ALL SELECT {keys}, -1, {unit} FROM ({_slots(units, keys, unit)})"""


def _slots(units: str, keys: str, unit: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5({unit}), {unit}) AS slot, count(*) OVER (PARTITION BY {keys}) AS n
        FROM (SELECT DISTINCT {keys}, {unit} FROM {units})"""


def sql_effects(source: str, keys: str, value: str = "v") -> str:
    """Effects of tumour against both references from long rows (keys, _arm, value)."""
    u = "(2 * (sum(r) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2.0::DOUBLE) / (count(*) FILTER (t)::DOUBLE * count(*) FILTER (NOT t)) - 1)"
    return f"""SELECT {keys}, max(e) FILTER (ref = 'a') AS adjacent, max(e) FILTER (ref = 'n') AS gtex, max(mt) FILTER (ref = 'a') AS median_tumor,
          max(mn) FILTER (ref = 'a') AS median_adjacent, max(mn) FILTER (ref = 'n') AS median_gtex
        FROM (SELECT {keys}, ref, {u} AS e, median(x) FILTER (t) AS mt, median(x) FILTER (NOT t) AS mn
          FROM (SELECT *, {v.sql_midrank('x', keys + ', ref')} AS r FROM (
            SELECT {keys}, _arm = 't' AS t, {value} AS x, unnest(CASE WHEN _arm = 't' THEN ['a', 'n'] ELSE [_arm] END) AS ref FROM {source}))
          GROUP BY {keys}, ref HAVING count(*) FILTER (t) > 0 AND count(*) FILTER (NOT t) > 0)
        GROUP BY {keys} HAVING adjacent IS NOT NULL AND gtex IS NOT NULL"""


# ---------------------------------------------------------------- bootstrap and consensus

def selection(s, d):
    return r_ops.candidate_selection(ge.priority(s, d), ge.confidence(s, d), per_cancer=40)


@mart("mart_bootstrap")
def bootstrap(s, d):
    return r_ops.bootstrap_stability(native_rows(panel(s, d)), ge.priority(s, d), selection(s, d), iterations=RUNS, top_k=10, seed=SEED)


@mart("mart_consensus")
def consensus(s, d):
    return s_ops.consensus_candidates(
        ge.priority(s, d), ge.confidence(s, d), gc.triangulation(s, d), bootstrap(s, d), gc.validation(s, d), gs.support(s, d), gs.paired(s, d)
    )


@mart("mart_comparison")
def comparison(s, d):
    return a_ops.method_comparison(gc.triangulation(s, d), gc.validation(s, d), top_k=(10, 25, 50, 100, 200))


@mart("mart_ablation")
def ablation(s, d):
    return a_ops.consensus_ablation(consensus(s, d), top_k=(10, 25, 50, 100, 200))


v.SQL_VIEWS["selection"] = (("priority", "confidence"), """
    SELECT cancer_type, gene_symbol, candidate_priority_rank, priority_score, CASE WHEN high THEN 'high' ELSE 'not_high' END AS evidence_confidence_tier,
           CASE WHEN candidate_priority_rank <= 40 AND high THEN 'top_priority_and_high_confidence' WHEN high THEN 'high_confidence' ELSE 'top_priority' END AS candidate_selection_reason
    FROM (SELECT p.cancer_type, p.gene_symbol, p.priority_score, c.confidence_tier = 'high' AS high,
                 row_number() OVER (PARTITION BY p.cancer_type ORDER BY p.priority_score DESC, p.gene_symbol) AS candidate_priority_rank
          FROM priority p JOIN confidence c ON p.cancer_type = c.cancer_type AND p.gene_symbol = c.gene_symbol)
    WHERE candidate_priority_rank <= 40 OR high""")
v.SQL_VIEWS["panel_rows"] = (("panel", "priority"), """
    SELECT p.* FROM panel p JOIN priority q ON p.cancer_type = q.cancer_type AND p.gene_symbol = q.gene_symbol""")
v.SQL_VIEWS["boot_draws"] = (("panel_rows",), sql_draws("panel_rows", "cancer_type _arm", "sample_id", SEED, RUNS))
_D = lambda c: f"CASE WHEN {c} >= 1 THEN 1 WHEN {c} <= -1 THEN -1 ELSE 0 END"
v.SQL_VIEWS["boot_runs"] = (("panel_rows", "boot_draws"), f"""
    SELECT *, {_D('tcga_fc')} AS tx, {_D('gtex_fc')} AS gx, count(*) OVER (PARTITION BY cancer_type, replicate) AS genes,
           row_number() OVER (PARTITION BY cancer_type, replicate ORDER BY abs(tcga_fc) DESC, gene_symbol) AS tcga_rank,
           row_number() OVER (PARTITION BY cancer_type, replicate ORDER BY abs(gtex_fc) DESC, gene_symbol) AS gtex_rank
    FROM (SELECT cancer_type, gene_symbol, replicate, log2((t + 1) / (a + 1)) AS tcga_fc, log2((t + 1) / (n + 1)) AS gtex_fc
          FROM (SELECT cancer_type, gene_symbol, replicate, median(native_value) FILTER (_arm = 't') AS t, median(native_value) FILTER (_arm = 'a') AS a,
                       median(native_value) FILTER (_arm = 'n') AS n
                FROM (SELECT * FROM panel_rows QUALIFY count(*) OVER (PARTITION BY cancer_type, gene_symbol)
                        = (SELECT count(*) FROM (SELECT DISTINCT x.cancer_type, x._arm, x.sample_id FROM panel_rows x) y WHERE y.cancer_type = panel_rows.cancer_type))
                JOIN boot_draws USING (cancer_type, _arm, sample_id) GROUP BY 1, 2, 3))""")


def _q(c: str, q: float) -> str:
    return f"quantile_cont({c}::DOUBLE, {q}) FILTER (r.replicate >= 0)"


_BOOT_AGG = ", ".join(
    f"{_q(f'r.{ref}_{src}', q)} AS {ref}_{name}"
    for ref in ("tcga", "gtex")
    for src, names in (("rank", ("median_rank", "rank_ci_low", "rank_ci_high")), ("fc", ("median_log2_fc", "log2_fc_ci_low", "log2_fc_ci_high")))
    for name, q in zip(names, (0.5, 0.025, 0.975))
)
_A = lambda cond: f"avg(({cond})::INT) FILTER (r.replicate >= 0)"
v.SQL_VIEWS["bootstrap"] = (("boot_runs", "selection"), f"""
    SELECT * EXCLUDE (precision), least(1, greatest(0, precision)) AS rank_precision, score AS bootstrap_stability_score,
           CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'moderate' WHEN score >= 0.4 THEN 'limited' ELSE 'unstable' END AS bootstrap_stability_tier,
           {RUNS}::BIGINT AS bootstrap_iterations, {SEED}::BIGINT AS random_seed, '{r_ops.BOOTSTRAP_CAVEAT}' AS bootstrap_caveat
    FROM (SELECT *, least(1, greatest(0, (tcga_direction_stability + gtex_direction_stability + reference_concordance_rate + least(1, greatest(0, precision))) * 0.25::DOUBLE)) AS score
    FROM (SELECT *, 1 - ((tcga_rank_ci_high - tcga_rank_ci_low) + (gtex_rank_ci_high - gtex_rank_ci_low)) / 2 / greatest(ranking_universe_gene_count - 1, 1) AS precision
    FROM (SELECT r.cancer_type, r.gene_symbol, least(10, max(r.genes)) AS top_k, max(r.genes) AS ranking_universe_gene_count,
             {_A('r.tx = b.tx')} AS tcga_direction_stability, {_A('r.gx = b.gx')} AS gtex_direction_stability, {_A('r.tx = r.gx')} AS reference_concordance_rate,
             {_A('r.tx * r.gx = -1')} AS opposite_direction_rate, {_A('r.tcga_rank <= least(10, r.genes)')} AS tcga_top_k_selection_rate,
             {_A('r.gtex_rank <= least(10, r.genes)')} AS gtex_top_k_selection_rate, {_BOOT_AGG}
          FROM boot_runs r JOIN boot_runs b ON b.replicate = -1 AND r.cancer_type = b.cancer_type AND r.gene_symbol = b.gene_symbol GROUP BY 1, 2)))
    JOIN selection USING (cancer_type, gene_symbol)""")

_U = lambda c: f"least(1, greatest(0, coalesce({c}, 0)))"


def _factor(column: str, pairs: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in pairs.items()) + " ELSE 0 END"


_WEIGHTS = " + ".join(f"{c} * {w}::DOUBLE" for c, w in s_ops.COMPONENT_WEIGHTS.items())
v.SQL_VIEWS["consensus"] = (("priority", "confidence", "triangulation", "bootstrap", "validation", "support", "paired_support"), f"""
    SELECT *, CASE WHEN consensus_score >= 0.75 AND rejection_reasons = 'none' THEN 'prioritized' WHEN consensus_score >= 0.55 AND rejection_reasons = 'none' THEN 'watchlist' ELSE 'deprioritized' END AS consensus_decision,
           CASE WHEN consensus_score >= 0.8 AND rejection_reasons = 'none' THEN 'strong_candidate' WHEN consensus_score >= 0.65 AND rejection_reasons = 'none' THEN 'research_candidate'
                WHEN consensus_score >= 0.45 THEN 'exploratory' ELSE 'deprioritized' END AS publication_tier,
           '{s_ops.CONSENSUS_CAVEAT}' AS consensus_caveat
    FROM (SELECT *, coalesce(nullif(concat_ws(';',
             CASE WHEN direction_agreement = 'discordant' OR validation_tier = 'discordant' THEN 'reprocessing_corroboration_discordant' END,
             CASE WHEN reference_concordance IN ('reference_sensitive', 'discordant') THEN 'reference_sensitive_or_discordant' END,
             CASE WHEN bootstrap_stability_tier IN ('limited', 'unstable') THEN 'bootstrap_support_weak' END,
             CASE WHEN confidence_tier IN ('limited', 'low') THEN 'evidence_confidence_weak' END,
             CASE WHEN statistical_support_tier = 'discordant' THEN 'statistical_support_discordant' END,
             CASE WHEN paired_support_tier = 'paired_discordant' THEN 'paired_support_discordant' END,
             CASE WHEN consensus_score < 0.45 THEN 'low_consensus_score' END), ''), 'none') AS rejection_reasons
    FROM (SELECT *, round(least(1, greatest(0, {_WEIGHTS})), 6) AS consensus_score, round(evidence_component_count / 8, 6) AS evidence_completeness
    FROM (SELECT *, priority_score AS priority_component, overall_confidence AS confidence_component, mutation_frequency AS mutation_component,
             reference_stability_score * {_factor('reference_concordance', {'concordant_up': 1, 'concordant_down': 1, 'concordant_stable': 1, 'reference_sensitive': 0.35})} AS reference_component,
             bootstrap_stability_score * {_factor('bootstrap_stability_tier', {'high': 1, 'moderate': 1, 'limited': 0.5})} AS bootstrap_component,
             validation_score * {_factor('direction_agreement', {'concordant': 1, 'inconclusive': 0.5})} AS reprocessing_component,
             statistical_support_score * {_factor('statistical_support_tier', {'replicated_fdr': 1, 'recount3_fdr_supported': 0.65, 'native_only_fdr': 0.35, 'limited': 0.15})} AS statistical_component,
             paired_support_score * {_factor('paired_support_tier', {'paired_replicated': 1, 'paired_internal_fdr': 0.65, 'limited': 0.15})} AS paired_component,
             (priority_score > 0)::BIGINT + (overall_confidence > 0)::BIGINT + (mutation_frequency > 0)::BIGINT + (reference_concordance <> 'missing')::BIGINT
             + (bootstrap_stability_tier <> 'missing')::BIGINT + (validation_tier <> 'missing')::BIGINT + (statistical_support_tier <> 'missing')::BIGINT
             + (paired_support_tier <> 'missing')::BIGINT AS evidence_component_count
    FROM (SELECT p.cancer_type, p.gene_symbol, {_U('p.priority_score')} AS priority_score, p.priority_tier, {_U('p.mutation_frequency')} AS mutation_frequency,
             p.mutated_sample_count, p.total_profiled_sample_count, p.log2_fold_change, p.abs_log2_fold_change,
             {_U('c.overall_confidence')} AS overall_confidence, coalesce(c.confidence_tier, 'missing') AS confidence_tier,
             {_U('t.reference_stability_score')} AS reference_stability_score, coalesce(t.reference_concordance, 'missing') AS reference_concordance,
             {_U('b.bootstrap_stability_score')} AS bootstrap_stability_score, coalesce(b.bootstrap_stability_tier, 'missing') AS bootstrap_stability_tier,
             {_U('v.validation_score')} AS validation_score, coalesce(v.validation_tier, 'missing') AS validation_tier, coalesce(v.direction_agreement, 'missing') AS direction_agreement,
             {_U('s.statistical_support_score')} AS statistical_support_score, coalesce(s.statistical_support_tier, 'missing') AS statistical_support_tier,
             coalesce(s.native_fdr_q_value, 1) AS native_fdr_q_value, coalesce(s.recount3_fdr_q_value, 1) AS recount3_fdr_q_value,
             coalesce(s.native_rank_biserial, 0) AS native_rank_biserial, coalesce(s.recount3_rank_biserial, 0) AS recount3_rank_biserial,
             coalesce(q.matched_case_count, 0) AS matched_case_count, coalesce(q.paired_fdr_q_value, 1) AS paired_fdr_q_value, coalesce(q.paired_rank_biserial, 0) AS paired_rank_biserial,
             {_U('q.paired_support_score')} AS paired_support_score, coalesce(q.paired_support_tier, 'missing') AS paired_support_tier
      FROM priority p LEFT JOIN confidence c USING (cancer_type, gene_symbol) LEFT JOIN triangulation t USING (cancer_type, gene_symbol)
      LEFT JOIN (SELECT * REPLACE (round(bootstrap_stability_score, 6) AS bootstrap_stability_score) FROM bootstrap) b USING (cancer_type, gene_symbol)
      LEFT JOIN validation v USING (cancer_type, gene_symbol) LEFT JOIN support s USING (cancer_type, gene_symbol) LEFT JOIN paired_support q USING (cancer_type, gene_symbol)))))""")
CONSENSUS_DOUBLES = (
    "mutation_frequency log2_fold_change abs_log2_fold_change statistical_support_score native_fdr_q_value recount3_fdr_q_value native_rank_biserial "
    "recount3_rank_biserial paired_fdr_q_value paired_rank_biserial paired_support_score " + " ".join(s_ops.COMPONENT_WEIGHTS)
)

_KS = "(VALUES (10), (25), (50), (100), (200)) k(k)"
_DIR = lambda c: f"CASE WHEN {c} >= 1 THEN 'up' WHEN {c} <= -1 THEN 'down' ELSE 'stable' END"
v.SQL_VIEWS["method_pairs"] = (("triangulation", "validation"), f"""
    SELECT a.cancer_type, a.method AS method_a, b.method AS method_b, a.e AS ea, b.e AS eb, a.place AS ra, b.place AS rb, a.genes, {_DIR('a.e')} AS da, {_DIR('b.e')} AS db, a.ord, b.ord
    FROM (SELECT *, row_number() OVER (PARTITION BY cancer_type, method ORDER BY abs(e) DESC, gene_symbol) AS place, count(*) OVER (PARTITION BY cancer_type, method) AS genes FROM meth) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY cancer_type, method ORDER BY abs(e) DESC, gene_symbol) AS place FROM meth) b
      ON a.cancer_type = b.cancer_type AND a.gene_symbol = b.gene_symbol AND a.ord < b.ord""")
v.SQL_VIEWS["meth"] = (("triangulation", "validation"), """
    SELECT cancer_type, gene_symbol, unnest([{'method': 'gtex_native', 'ord': 1, 'e': log2_fc_tumor_vs_gtex}, {'method': 'tcga_adjacent', 'ord': 2, 'e': log2_fc_tumor_vs_tcga_normal},
           {'method': 'recount3_uniform', 'ord': 3, 'e': recount3_log2_fold_change}], recursive := true)
    FROM triangulation JOIN validation USING (cancer_type, gene_symbol)""")
v.SQL_VIEWS["method_pairs"] = (("meth",), v.SQL_VIEWS["method_pairs"][1])
v.SQL_VIEWS["comparison"] = (("method_pairs",), f"""
    SELECT cancer_type, method_a, method_b, common_gene_count, top_k, top_k_a_count, top_k_b_count, top_k_overlap_count, round(j, 6) AS top_k_jaccard,
           round(td, 6) AS top_k_direction_concordance, round(ud, 6) AS universe_direction_concordance, regulated_union_gene_count, round(rd, 6) AS regulated_direction_concordance,
           round(rho, 6) AS spearman_abs_effect, round(delta, 6) AS median_abs_effect_delta,
           CASE WHEN j >= 0.5 AND rd >= 0.8 AND rho >= 0.5 THEN 'high' WHEN j >= 0.25 AND rd >= 0.65 AND rho >= 0.25 THEN 'moderate' ELSE 'limited' END AS agreement_tier,
           '{a_ops.REFERENCE_CAVEAT}' AS evaluation_caveat
    FROM (SELECT cancer_type, method_a, method_b, count(*) AS common_gene_count, least(k, max(genes)) AS top_k, count(*) FILTER (ra <= k) AS top_k_a_count,
            count(*) FILTER (rb <= k) AS top_k_b_count, count(*) FILTER (ra <= k AND rb <= k) AS top_k_overlap_count,
            count(*) FILTER (ra <= k AND rb <= k) / count(*) FILTER (ra <= k OR rb <= k) AS j,
            coalesce(count(*) FILTER (ra <= k AND rb <= k AND da = db) / nullif(count(*) FILTER (ra <= k AND rb <= k), 0), 0) AS td, avg((da = db)::INT) AS ud,
            count(*) FILTER (da <> 'stable' OR db <> 'stable') AS regulated_union_gene_count,
            coalesce(count(*) FILTER (da = db AND da <> 'stable') / nullif(count(*) FILTER (da <> 'stable' OR db <> 'stable'), 0), 1) AS rd
          FROM method_pairs, {_KS} GROUP BY 1, 2, 3, k)
    JOIN (SELECT cancer_type, method_a, method_b, corr(ra, rb) AS rho, median(abs(abs(ea) - abs(eb))) AS delta FROM (
            SELECT *, {v.sql_midrank('abs(ea)', 'cancer_type, method_a, method_b')} AS ra, {v.sql_midrank('abs(eb)', 'cancer_type, method_a, method_b')} AS rb
            FROM (SELECT * EXCLUDE (ra, rb) FROM method_pairs)) GROUP BY 1, 2, 3) USING (cancer_type, method_a, method_b)""")


def _scenarios() -> str:
    parts = []
    for name, omitted in a_ops.ABLATION_SCENARIOS.items():
        kept = {c: w for c, w in s_ops.COMPONENT_WEIGHTS.items() if c not in omitted}
        score = "(" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in kept.items()) + f") / {sum(kept.values())!r}::DOUBLE"
        parts.append(f"SELECT cancer_type, gene_symbol, consensus_score AS base, consensus_decision = 'prioritized' AS chosen, '{name}' AS ablation_scenario, "
                     f"'{','.join(omitted)}' AS omitted_components, {round(sum(kept.values()), 6)}::DOUBLE AS retained_weight, {score} AS ablated FROM consensus")
    return " UNION ALL ".join(parts)


v.SQL_VIEWS["ablated"] = (("consensus",), f"""
    SELECT *, row_number() OVER (PARTITION BY cancer_type, ablation_scenario ORDER BY base DESC, gene_symbol) AS rb, count(*) OVER (PARTITION BY cancer_type, ablation_scenario) AS genes,
           row_number() OVER (PARTITION BY cancer_type, ablation_scenario ORDER BY ablated DESC, gene_symbol) AS ra,
           {v.sql_midrank('base', 'cancer_type, ablation_scenario')} AS mb, {v.sql_midrank('ablated', 'cancer_type, ablation_scenario')} AS ma FROM ({_scenarios()})""")
v.SQL_VIEWS["ablation"] = (("ablated",), f"""
    SELECT cancer_type, ablation_scenario, omitted_components, retained_weight, common_gene_count, top_k, top_k_overlap_count, round(j, 6) AS top_k_jaccard, round(rho, 6) AS spearman_consensus_score,
           round(shift, 6) AS median_baseline_top_k_rank_shift, round(delta, 6) AS median_absolute_score_delta, round(widest, 6) AS max_absolute_score_delta, baseline_prioritized_count,
           fixed_threshold_retained_count, round(fixed_threshold_retained_count / nullif(baseline_prioritized_count, 0), 6) AS fixed_threshold_retention_rate,
           CASE WHEN j >= 0.8 AND rho >= 0.9 THEN 'robust' WHEN j >= 0.6 AND rho >= 0.75 THEN 'moderate' ELSE 'sensitive' END AS sensitivity_tier, '{a_ops.ABLATION_CAVEAT}' AS evaluation_caveat
    FROM (SELECT cancer_type, ablation_scenario, omitted_components, retained_weight, count(*) AS common_gene_count, least(k, max(genes)) AS top_k,
            count(*) FILTER (ra <= k AND rb <= k) AS top_k_overlap_count, count(*) FILTER (ra <= k AND rb <= k) / count(*) FILTER (ra <= k OR rb <= k) AS j, corr(mb, ma) AS rho,
            median(abs(ra - rb)) FILTER (rb <= k) AS shift, median(abs(base - ablated)) AS delta, max(abs(base - ablated)) AS widest, count(*) FILTER (chosen) AS baseline_prioritized_count,
            count(*) FILTER (chosen AND ablated >= 0.75) AS fixed_threshold_retained_count
          FROM ablated, {_KS} GROUP BY 1, 2, 3, 4, k)""")


# ---------------------------------------------------------------- partitions

@mart("sample_index")
def index(s, d):
    return r_ops.sample_index(v.tumour(s, d), v.reference(s, d), v.cohorts(s), check=False)


def all_index(s, d):
    cases = v.tumour(s, d).select(F.lit("TCGA").alias("source"), F.col("project_id").alias("cancer_type"), F.col("case_id").alias("unit_id"),
                                  F.col("sample_type").alias("group"), "sample_id")
    return cases


@mart("split")
def split(s, d):
    return r_ops.grouped_partition(index(s, d), fraction=0.4, seed=SEED, scope=["cancer_type"])


def global_split(s, d):
    return r_ops.global_partition(index(s, d), fraction=0.4, seed=SEED)


@mart("balanced")
def balanced(s, d):
    return r_ops.balanced_units(split(s, d), maximum=50, seed=SEED)


def paired_balanced(s, d):
    return r_ops.balanced_units(split(s, d), maximum=50, seed=SEED, paired_only=True)


v.SQL_VIEWS["index"] = (("tumour", "mapped_reference"), """
    SELECT source, cancer_type, unit_id, "group", min(sample_id) AS sample_id FROM (
      SELECT 'TCGA' AS source, project_id AS cancer_type, case_id AS unit_id, CASE WHEN sample_type = 'Primary Tumor' THEN 'tumor' ELSE 'adjacent' END AS "group", sample_id FROM tumour
      UNION ALL SELECT 'GTEX', cancer_type, donor_id, 'gtex', gtex_sample_id FROM mapped_reference) GROUP BY 1, 2, 3, 4""")


def _split_sql(scope: str, label: str) -> str:
    by = f"{scope}source, unit_id"
    key = ", ".join(c.strip() for c in by.split(","))
    return f"""SELECT i.*, CASE WHEN n > 1 AND place <= least(n - 1, greatest(1, round_even(n * 0.4::DOUBLE, 0))) THEN 'holdout' ELSE 'development' END AS partition
      FROM index i JOIN (
        SELECT *, count(*) OVER (PARTITION BY {scope}source, stratum) AS n,
               row_number() OVER (PARTITION BY {scope}source, stratum ORDER BY md5(concat_ws('|', {SEED}, {key})), unit_id) AS place
        FROM (SELECT {by}, string_agg(DISTINCT {label}, '|' ORDER BY {label}) AS stratum FROM index GROUP BY ALL)) USING ({by})"""


v.SQL_VIEWS["split"] = (("index",), _split_sql("cancer_type, ", '"group"'))
v.SQL_VIEWS["global_split"] = (("index",), _split_sql("", "cancer_type || ':' || \"group\""))
v.SQL_VIEWS["quota"] = (("split",), """
    SELECT cancer_type, partition, CASE WHEN count(*) = 3 THEN least(50, min(c)) ELSE 0 END AS quota
    FROM (SELECT cancer_type, partition, "group", count(*) AS c FROM split GROUP BY 1, 2, 3) GROUP BY 1, 2""")
v.SQL_VIEWS["balanced"] = (("split", "quota"), f"""
    SELECT * EXCLUDE (quota, place) FROM (
      SELECT *, row_number() OVER (PARTITION BY cancer_type, partition, "group" ORDER BY md5(concat_ws('|', {SEED}, cancer_type, partition, "group", unit_id)), unit_id, sample_id) AS place
      FROM split JOIN quota USING (cancer_type, partition)) WHERE place <= quota""")
v.SQL_VIEWS["shared_cases"] = (("split",), """
    SELECT cancer_type, partition, unit_id FROM split WHERE "group" <> 'gtex' GROUP BY 1, 2, 3 HAVING count(DISTINCT "group") = 2""")
v.SQL_VIEWS["paired_balanced"] = (("split", "quota", "shared_cases"), f"""
    WITH lim AS (SELECT cancer_type, partition, least(quota, c) AS quota FROM quota JOIN (SELECT cancer_type, partition, count(*) AS c FROM shared_cases GROUP BY 1, 2) USING (cancer_type, partition)),
    cases AS (SELECT cancer_type, partition, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY cancer_type, partition ORDER BY md5(concat_ws('|', {SEED}, cancer_type, partition, 'case', unit_id)), unit_id) AS place
              FROM shared_cases JOIN lim USING (cancer_type, partition)) WHERE place <= quota)
    SELECT s.* FROM split s JOIN cases USING (cancer_type, partition, unit_id) WHERE "group" <> 'gtex'
    UNION ALL BY NAME SELECT * EXCLUDE (quota, place) FROM (
      SELECT s.*, quota, row_number() OVER (PARTITION BY s.cancer_type, s.partition ORDER BY md5(concat_ws('|', {SEED}, s.cancer_type, s.partition, 'donor', unit_id)), unit_id, sample_id) AS place
      FROM split s JOIN lim ON s.cancer_type = lim.cancer_type AND s.partition = lim.partition WHERE "group" = 'gtex') WHERE place <= quota""")


# ---------------------------------------------------------------- rankings on the dense table

@mart("dense_split")
def dense_split(s, d):
    """The dense table with its units assigned to development or holdout."""
    rows = native_rows(dense(s, d))
    units = rows.select(
        F.when(F.col("_arm") == "n", "GTEX").otherwise("TCGA").alias("source"), "cancer_type", "unit_id", F.col("_arm").alias("group")
    ).distinct()
    labelled = r_ops.grouped_partition(units, fraction=0.5, seed=SEED, scope=["cancer_type"]).select("cancer_type", "unit_id", F.col("group").alias("_arm"), "partition")
    return rows.join(labelled, ["cancer_type", "unit_id", "_arm"])


def _side(s, d, name):
    return dense_split(s, d).where(F.col("partition") == name).drop("partition")


@mart("train_effects")
def train_effects(s, d):
    return r_ops.resampled_effects(_side(s, d, "development"), replicates=RUNS, seed=SEED)


@mart("test_effects")
def test_effects(s, d):
    return r_ops.resampled_effects(_side(s, d, "holdout"), replicates=RUNS, seed=SEED + 1)


@mart("study_scores")
def study_scores(s, d):
    return r_ops.all_scores(train_effects(s, d))


def dense_effects(s, d):
    return r_ops.contrast_effects(native_rows(dense(s, d)))


def _train_base(s, d):
    return train_effects(s, d).where(F.col("replicate") == -1)


v.SQL_VIEWS["dense_split"] = (("dense",), f"""
    SELECT d.*, partition FROM dense d JOIN (
      SELECT cancer_type, source, unit_id, CASE WHEN n > 1 AND place <= least(n - 1, greatest(1, round_even(n * 0.5::DOUBLE, 0))) THEN 'holdout' ELSE 'development' END AS partition FROM (
        SELECT *, count(*) OVER (PARTITION BY cancer_type, source, stratum) AS n,
               row_number() OVER (PARTITION BY cancer_type, source, stratum ORDER BY md5(concat_ws('|', {SEED}, cancer_type, source, unit_id)), unit_id) AS place
        FROM (SELECT cancer_type, CASE WHEN _arm = 'n' THEN 'GTEX' ELSE 'TCGA' END AS source, unit_id, string_agg(DISTINCT _arm, '|' ORDER BY _arm) AS stratum FROM dense GROUP BY 1, 2, 3))) p
    ON d.cancer_type = p.cancer_type AND d.unit_id = p.unit_id AND (d._arm = 'n') = (p.source = 'GTEX')""")
for _name, _partition, _seed in (("train", "development", SEED), ("test", "holdout", SEED + 1)):
    v.SQL_VIEWS[f"{_name}_rows"] = (("dense_split",), f"SELECT *, CASE WHEN _arm = 'n' THEN 'donor' ELSE 'case' END AS _pool, native_value AS v FROM dense_split WHERE partition = '{_partition}'")
    v.SQL_VIEWS[f"{_name}_draws"] = ((f"{_name}_rows",), sql_draws(f"{_name}_rows", "cancer_type _pool", "unit_id", _seed, RUNS))
    v.SQL_VIEWS[f"{_name}_effects"] = ((f"{_name}_rows", f"{_name}_draws"), sql_effects(
        f"(SELECT * FROM {_name}_rows JOIN {_name}_draws USING (cancer_type, _pool, unit_id))", "cancer_type, gene_symbol, replicate"))
v.SQL_VIEWS["dense_effects"] = (("dense",), sql_effects("dense", "cancer_type, gene_symbol", "native_value"))


def _rra(a: str, b: str) -> str:
    return f"least(1, 2 * least(1 - (1 - least({a}, {b})) * (1 - least({a}, {b})), greatest({a}, {b}) * greatest({a}, {b})))"


def _scores_sql(effects: str) -> str:
    fold = lambda ref: f"abs(log2((median_tumor + 1) / ({ref} + 1)))"
    return f"""SELECT cancer_type, gene_symbol, unnest([
        {{'method': 'gtex_log2_fc', 'score': {fold('median_gtex')}, 'orientation': sign(gtex)::DOUBLE}}, {{'method': 'adjacent_log2_fc', 'score': {fold('median_adjacent')}, 'orientation': sign(adjacent)::DOUBLE}},
        {{'method': 'gtex_rank_biserial', 'score': abs(gtex), 'orientation': sign(gtex)::DOUBLE}}, {{'method': 'adjacent_rank_biserial', 'score': abs(adjacent), 'orientation': sign(adjacent)::DOUBLE}},
        {{'method': 'mean_rank', 'score': 1 - (pa + pg) / 2, 'orientation': o}}, {{'method': 'rra_style', 'score': 1 - {_rra('pa', 'pg')}, 'orientation': o}},
        {{'method': 'reference_maximin', 'score': greatest(0, least(o * adjacent, o * gtex)), 'orientation': o}}], recursive := true)
      FROM (SELECT *, sign(adjacent + gtex)::DOUBLE AS o, {v.sql_midrank('abs(adjacent)', 'cancer_type', True)} / count(*) OVER (PARTITION BY cancer_type) AS pa,
                   {v.sql_midrank('abs(gtex)', 'cancer_type', True)} / count(*) OVER (PARTITION BY cancer_type) AS pg FROM {effects})"""


v.SQL_VIEWS["dense_scores"] = (("dense_effects",), _scores_sql("dense_effects"))
v.SQL_VIEWS["study_scores"] = (("train_effects",), _scores_sql("(SELECT * FROM train_effects WHERE replicate = -1)") + f""" UNION ALL BY NAME
    SELECT cancer_type, gene_symbol, '{r_ops.STABILITY}' AS method, greatest(0, quantile_cont(least(e.adjacent * o, e.gtex * o), 0.1)) AS score, max(o) AS orientation
    FROM train_effects e JOIN (SELECT cancer_type, gene_symbol, sign(adjacent + gtex)::DOUBLE AS o FROM train_effects WHERE replicate = -1) USING (cancer_type, gene_symbol)
    WHERE replicate >= 0 GROUP BY 1, 2""")


def _tops(scores: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cancer_type, method ORDER BY round(score, 12) DESC, gene_symbol) AS rank FROM {scores}),
        (VALUES (5::BIGINT), (10)) k(top_k) WHERE rank <= top_k"""


v.SQL_VIEWS["tops"] = (("study_scores",), _tops("study_scores"))
v.SQL_VIEWS["published"] = (("train_effects",), f"""
    SELECT cancer_type, gene_symbol, adjacent_rank, gtex_rank, {_rra('adjacent_rank / n', 'gtex_rank / n')} AS rra_score, adjacent, gtex
    FROM (SELECT *, count(*) OVER (PARTITION BY cancer_type) AS n, row_number() OVER (PARTITION BY cancer_type ORDER BY round(abs(adjacent), 12) DESC, gene_symbol) AS adjacent_rank,
                 row_number() OVER (PARTITION BY cancer_type ORDER BY round(abs(gtex), 12) DESC, gene_symbol) AS gtex_rank FROM train_effects WHERE replicate = -1)""")
v.SQL_VIEWS["rra_tops"] = (("published",), _tops("(SELECT cancer_type, gene_symbol, 'published_rra' AS method, 1 - rra_score AS score, sign(adjacent + gtex)::DOUBLE AS orientation FROM published)"))


def _evaluation_sql(tops: str, where: str = "true") -> str:
    worst = "least(e.adjacent * t.orientation, e.gtex * t.orientation)"
    cols = []
    for m in r_ops.METRICS:
        cols += [f"max({m}) FILTER (replicate = -1) AS {m}", f"max(p_{m} - {m}) FILTER (replicate = -1) AS proposed_minus_baseline_{m}"]
        for side, q in (("low", 0.025), ("high", 0.975)):
            cols += [f"quantile_cont({m}, {q}) FILTER (replicate >= 0) AS {m}_ci_{side}",
                     f"quantile_cont(p_{m} - {m}, {q}) FILTER (replicate >= 0) AS proposed_minus_baseline_{m}_ci_{side}"]
    held = ""
    for name in ("adjacent", "gtex"):
        held += f""" JOIN (SELECT t.cancer_type, t.method, t.top_k, count(h.gene_symbol) / (2 * t.top_k - count(h.gene_symbol)) AS heldout_{name}_jaccard FROM {tops} t LEFT JOIN (
            SELECT cancer_type, gene_symbol, row_number() OVER (PARTITION BY cancer_type ORDER BY round(abs({name}), 12) DESC, gene_symbol) AS hr FROM test_effects WHERE replicate = -1) h
            ON t.cancer_type = h.cancer_type AND t.gene_symbol = h.gene_symbol AND h.hr <= t.top_k GROUP BY 1, 2, 3) USING (cancer_type, method, top_k)"""
    return f"""SELECT * FROM (SELECT cancer_type, method, top_k, count(*) AS selected_count, count(*) FILTER (score > 0) AS positive_score_count FROM {tops} GROUP BY 1, 2, 3)
      JOIN (SELECT cancer_type, method, top_k, {', '.join(cols)} FROM (
        SELECT t.cancer_type, t.method, t.top_k, e.replicate, avg(({worst} >= 0.3)::INT) AS replication_fraction, avg({worst}) AS mean_worst_reference_effect
        FROM {tops} t JOIN test_effects e ON t.cancer_type = e.cancer_type AND t.gene_symbol = e.gene_symbol GROUP BY 1, 2, 3, 4)
        LEFT JOIN (SELECT t.cancer_type, t.top_k, e.replicate, avg(({worst} >= 0.3)::INT) AS p_replication_fraction, avg({worst}) AS p_mean_worst_reference_effect
          FROM tops t JOIN test_effects e ON t.cancer_type = e.cancer_type AND t.gene_symbol = e.gene_symbol WHERE t.method = '{r_ops.STABILITY}' GROUP BY 1, 2, 3)
        USING (cancer_type, top_k, replicate) GROUP BY 1, 2, 3) USING (cancer_type, method, top_k){held}"""


v.SQL_VIEWS["evaluation"] = (("tops", "test_effects"), _evaluation_sql("tops"))
v.SQL_VIEWS["rra_evaluation"] = (("tops", "rra_tops", "published", "test_effects"), f"""
    SELECT * FROM ({_evaluation_sql('rra_tops')})
    JOIN (SELECT cancer_type, method, top_k, count(*) FILTER (adjacent * gtex < 0) AS discordant_reference_direction_count,
                 count(*) FILTER (adjacent * gtex < 0) / top_k AS discordant_reference_direction_fraction
          FROM rra_tops JOIN published USING (cancer_type, gene_symbol) GROUP BY 1, 2, 3) USING (cancer_type, method, top_k)
    JOIN (SELECT r.cancer_type, r.method, r.top_k, count(h.gene_symbol) / (2 * r.top_k - count(h.gene_symbol)) AS rra_style_topk_jaccard
          FROM rra_tops r LEFT JOIN (SELECT * FROM tops WHERE method = 'rra_style') h USING (cancer_type, gene_symbol, top_k) GROUP BY 1, 2, 3) USING (cancer_type, method, top_k)""")
EVALUATION_DOUBLES = " ".join(
    f"{p}{m}{x}" for m in r_ops.METRICS for p in ("", "proposed_minus_baseline_") for x in ("", "_ci_low", "_ci_high")
) + " heldout_adjacent_jaccard heldout_gtex_jaccard"


# ---------------------------------------------------------------- pipeline agreement

def _tn(df):
    return df.where(F.col("_arm") != "a")


@mart("pipeline_pairs")
def pairs(s, d):
    rows = _tn(dense(s, d))
    keys = ["cancer_type", "_arm", "sample_id", "gene_symbol"]
    return a_ops.pipeline_pairs(rows.select(*keys, "unit_id", "native_value"), rows.select(*keys, "recount_value"))


@mart("pipeline_effects")
def effects(s, d):
    return a_ops.pipeline_effects(pairs(s, d))


@mart("specimens")
def specimens(s, d):
    return a_ops.specimen_agreement(pairs(s, d), top=10).withColumn("unit_id", F.substring_index("sample_id", "-", -1))


v.SQL_VIEWS["pipeline_pairs"] = (("dense",), """
    SELECT cancer_type, _arm, sample_id, gene_symbol, unit_id, native_value, recount_value, count(*) OVER w AS native_gene_count, count(*) OVER w AS recount_gene_count
    FROM dense WHERE _arm <> 'a' WINDOW w AS (PARTITION BY cancer_type, _arm, sample_id)""")


def _pipe_effects_sql(source: str, keys: str) -> str:
    def one(value: str, out: str) -> str:
        return f"""SELECT {keys}, 2 * (sum(r) FILTER (_arm = 't') - count(*) FILTER (_arm = 't') * (count(*) FILTER (_arm = 't') + 1) / 2.0::DOUBLE)
            / (count(*) FILTER (_arm = 't')::DOUBLE * count(*) FILTER (_arm = 'n')) - 1 AS {out}
            FROM (SELECT *, {v.sql_midrank(value, keys)} AS r FROM {source}) GROUP BY {keys} HAVING count(DISTINCT _arm) = 2"""
    return f"SELECT * FROM ({one('native_value', 'native_effect')}) JOIN ({one('recount_value', 'recount_effect')}) USING ({keys})"


v.SQL_VIEWS["pipeline_effects"] = (("pipeline_pairs",), _pipe_effects_sql("pipeline_pairs", "cancer_type, gene_symbol"))
_TAU = """(count(*) FILTER (sx * sy > 0) - count(*) FILTER (sx * sy < 0)) / nullif(sqrt(count(*) FILTER (sx <> 0)::DOUBLE * count(*) FILTER (sy <> 0)), 0)"""


def _tau_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {keys}, {_TAU} AS kendall_tau_b FROM (
        SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, sign(a.native_effect - b.native_effect) AS sx, sign(a.recount_effect - b.recount_effect) AS sy
        FROM {source} a JOIN {source} b ON {on} AND a.gene_symbol < b.gene_symbol) GROUP BY {keys}"""


def _direction_sql(source: str, keys: str) -> str:
    strong = "abs(native_effect) >= 0.1 AND abs(recount_effect) >= 0.1"
    return f"""SELECT {keys}, count(*) FILTER ({strong}) AS direction_denominator,
        count(*) FILTER ({strong} AND sign(native_effect) = sign(recount_effect)) / nullif(count(*) FILTER ({strong}), 0) AS direction_agreement FROM {source} GROUP BY {keys}"""


def _ties_sql(source: str, keys: str) -> str:
    on = ", ".join(k.strip() for k in keys.split(","))
    return f"""WITH lng AS (SELECT {on}, gene_symbol, unnest([{{'pipe': 'native', 's': abs(native_effect)}}, {{'pipe': 'recount', 's': abs(recount_effect)}}], recursive := true) FROM {source}),
      placed AS (SELECT *, row_number() OVER (PARTITION BY {on}, pipe ORDER BY s DESC, gene_symbol) AS place FROM lng),
      cut AS (SELECT {on}, pipe, place AS top_k, s AS cut FROM placed WHERE place IN (5, 10)),
      marked AS (SELECT p.*, c.top_k, p.s > c.cut AS forced FROM placed p JOIN cut c USING ({on}, pipe) WHERE p.s >= c.cut),
      slots AS (SELECT {on}, pipe, top_k, count(*) FILTER (NOT forced) AS ties, top_k - count(*) FILTER (forced) AS slots FROM marked GROUP BY {on}, pipe, top_k),
      drawn AS (SELECT * FROM (SELECT m.*, draw, slots, row_number() OVER (PARTITION BY {on}, pipe, top_k, draw, forced
          ORDER BY md5(concat_ws('|', {SEED}, {on}, top_k, pipe, draw, gene_symbol)), gene_symbol) AS p
          FROM marked m JOIN slots USING ({on}, pipe, top_k), range(0, {TIE_DRAWS}) r(draw)) WHERE forced OR p <= slots),
      sides AS (SELECT {on}, top_k, draw, gene_symbol, count(*) AS sides FROM (
          SELECT {on}, top_k, draw, gene_symbol FROM drawn UNION ALL SELECT {on}, top_k, -1, gene_symbol FROM marked WHERE place <= top_k) GROUP BY ALL),
      jac AS (SELECT {on}, top_k, draw, count(*) FILTER (sides = 2) / count(*) AS j FROM sides GROUP BY ALL)
      SELECT * FROM (SELECT {on}, top_k, max(j) FILTER (draw < 0) AS deterministic_jaccard, avg(j) FILTER (draw >= 0) AS tie_mean_jaccard,
          quantile_cont(j, 0.025) FILTER (draw >= 0) AS tie_q025_jaccard, quantile_cont(j, 0.975) FILTER (draw >= 0) AS tie_q975_jaccard FROM jac GROUP BY ALL)
      JOIN (SELECT {on}, top_k, max(ties) FILTER (pipe = 'native') AS native_boundary_ties, max(slots) FILTER (pipe = 'native') AS native_boundary_slots,
          max(ties) FILTER (pipe = 'recount') AS recount_boundary_ties, max(slots) FILTER (pipe = 'recount') AS recount_boundary_slots FROM slots GROUP BY ALL) USING ({on}, top_k)"""


v.SQL_VIEWS["complete_pairs"] = (("pipeline_pairs",), """
    SELECT * FROM pipeline_pairs QUALIFY count(*) OVER (PARTITION BY cancer_type, gene_symbol)
      = (SELECT count(*) FROM (SELECT DISTINCT cancer_type, _arm, sample_id FROM pipeline_pairs) y WHERE y.cancer_type = pipeline_pairs.cancer_type)""")
v.SQL_VIEWS["complete_effects"] = (("complete_pairs",), _pipe_effects_sql("complete_pairs", "cancer_type, gene_symbol"))
v.SQL_VIEWS["boot_pipe_draws"] = (("pipeline_pairs",), sql_draws("pipeline_pairs", "cancer_type _arm", "unit_id", SEED, RUNS))
v.SQL_VIEWS["boot_pipe_effects"] = (("pipeline_pairs", "boot_pipe_draws"), _pipe_effects_sql(
    "(SELECT * FROM pipeline_pairs JOIN boot_pipe_draws USING (cancer_type, _arm, unit_id))", "cancer_type, gene_symbol, replicate"))
v.SQL_VIEWS["specimens"] = (("pipeline_pairs",), f"""
    SELECT *, split_part(sample_id, '-', 2) AS unit_id FROM (
      SELECT cancer_type, _arm, sample_id, count(*) AS common_gene_count, max(native_gene_count) AS native_gene_count, max(recount_gene_count) AS recount_gene_count,
             count(*) FILTER (native_value > 0 AND recount_value > 0) AS jointly_detected_gene_count, count(*) FILTER (a <= 10 AND b <= 10) / count(*) FILTER (a <= 10 OR b <= 10) AS top100_jaccard,
             CASE WHEN count(*) >= 3 THEN corr(x, y) END AS spearman_all_common, CASE WHEN count(*) >= 3 THEN corr(x, y) END AS spearman_jointly_detected
      FROM (SELECT *, row_number() OVER (w ORDER BY native_value DESC, gene_symbol) AS a, row_number() OVER (w ORDER BY recount_value DESC, gene_symbol) AS b,
                   {v.sql_midrank('native_value', 'cancer_type, _arm, sample_id')} AS x, {v.sql_midrank('recount_value', 'cancer_type, _arm, sample_id')} AS y
            FROM pipeline_pairs WINDOW w AS (PARTITION BY cancer_type, _arm, sample_id)) GROUP BY 1, 2, 3)""")
v.SQL_VIEWS["agreement_long"] = (("specimens",), """
    SELECT cancer_type, _arm, unit_id, unnest([{'metric': 'spearman_all_common', 'x': spearman_all_common}, {'metric': 'top100_jaccard', 'x': top100_jaccard}], recursive := true) FROM specimens""")
v.SQL_VIEWS["agreement_draws"] = (("agreement_long",), sql_draws("agreement_long", "cancer_type _arm metric", "unit_id", SEED, RUNS))


# specimens of the crosswalk: line items of documents' shape are not needed, orders serve as specimens
def _crosswalk_inputs(s, d):
    rows = v.reprocessed(s, d).where(F.col("source") == "TCGA")
    selected = rows.select("source", F.col("project_id").alias("cohort"), "sample_id").distinct()
    order = F.regexp_extract("sample_id", r"^S(\d+)-", 1)
    metadata = selected.select("sample_id").distinct().select(
        "sample_id", order.alias("specimen_id"), F.substring(order, -2, 2).alias("unit_id"), F.when(order.endswith("7"), "controlled").otherwise("open").alias("access")
    )
    native = v.tumour(s, d).where(F.col("sample_type") == "Solid Tissue Normal").select(
        F.regexp_extract("sample_id", r"^S(\d+)-", 1).alias("specimen_id")
    ).distinct().withColumn("native_unit_id", F.substring("specimen_id", -2, 2))
    return selected, metadata, native


v.SQL_VIEWS["cw_selected"] = (("reprocessed",), "SELECT DISTINCT source, project_id AS cohort, sample_id FROM reprocessed WHERE source = 'TCGA'")
v.SQL_VIEWS["cw_metadata"] = (("cw_selected",), r"""
    SELECT *, substr(specimen_id, greatest(1, length(specimen_id) - 1)) AS unit_id, CASE WHEN specimen_id LIKE '%7' THEN 'controlled' ELSE 'open' END AS access
    FROM (SELECT DISTINCT sample_id, regexp_extract(sample_id, '^S(\d+)-', 1) AS specimen_id FROM cw_selected)""")
v.SQL_VIEWS["cw_native"] = (("tumour",), r"""
    SELECT *, substr(specimen_id, greatest(1, length(specimen_id) - 1)) AS native_unit_id
    FROM (SELECT DISTINCT regexp_extract(sample_id, '^S(\d+)-', 1) AS specimen_id FROM tumour WHERE sample_type = 'Solid Tissue Normal')""")


def crosswalk(s, d):
    return a_ops.specimen_crosswalk(*_crosswalk_inputs(s, d))


def _manifest_inputs(s, d):
    selected, metadata, native = _crosswalk_inputs(s, d)
    meta = selected.join(metadata.drop("access"), "sample_id")
    qc = meta.select("sample_id").distinct().withColumn("auc", F.length("sample_id").cast("double") - 8.0)
    return meta, qc, native.withColumnRenamed("specimen_id", "native_sample_id")


v.SQL_VIEWS["mm_meta"] = (("cw_selected", "cw_metadata"), "SELECT source, cohort, sample_id, specimen_id, unit_id, length(sample_id)::DOUBLE - 8 AS auc FROM cw_selected JOIN cw_metadata USING (sample_id)")
v.SQL_VIEWS["mm_good"] = (("mm_meta",), "SELECT *, count(*) OVER (PARTITION BY source, cohort, specimen_id) AS c FROM mm_meta WHERE auc > 0")
v.SQL_VIEWS["mm_matched"] = (("mm_good", "cw_native"), """
    SELECT source, cohort, sample_id AS recount_sample_id, g.specimen_id AS native_sample_id, unit_id, auc
    FROM mm_good g JOIN cw_native n ON g.specimen_id = n.specimen_id AND g.unit_id = n.native_unit_id WHERE c = 1""")


def specimen_manifest(s, d):
    return v.tumour(s, d).select(
        F.lit("TCGA").alias("source"), F.col("project_id").alias("cohort"), F.col("sample_type").alias("tissue_site"), F.col("case_id").alias("unit_id"),
        F.col("sample_id").alias("recount_sample_id"),
    ).distinct()


def truth_scores(s, d):
    """Rankings labelled by a rule on the gene, with the cohorts as repetitions."""
    return study_scores(s, d).select(
        F.lit("all").alias("scenario"), F.col("cancer_type").alias("repetition"), "method", "gene_symbol", "score",
        (F.length("gene_symbol") == 7).alias("truth"),
    )


v.SQL_VIEWS["truth_ranked"] = (("study_scores",), """
    SELECT 'all' AS scenario, cancer_type AS repetition, method, gene_symbol, length(gene_symbol) = 7 AS truth,
           row_number() OVER (PARTITION BY cancer_type, method ORDER BY round(score, 12) DESC, gene_symbol) AS place FROM study_scores""")
v.SQL_VIEWS["truth"] = (("truth_ranked",), """
    SELECT a.*, average_precision, recall_n / nullif(truths, 0) AS recall_at_k FROM (
      SELECT scenario, repetition, method, top_k, avg(truth::INT) AS precision_at_k, count(*) FILTER (truth) AS recall_n FROM truth_ranked, (VALUES (5::BIGINT), (10)) k(top_k) WHERE place <= top_k GROUP BY 1, 2, 3, 4) a
    JOIN (SELECT scenario, repetition, method, avg(h / place) FILTER (truth) AS average_precision, count(*) FILTER (truth) AS truths FROM (
      SELECT *, count(*) FILTER (truth) OVER (PARTITION BY scenario, repetition, method ORDER BY place) AS h FROM truth_ranked) GROUP BY 1, 2, 3) USING (scenario, repetition, method)""")


@mart("truth_metrics")
def truth_metrics(s, d):
    return a_ops.ranking_truth(truth_scores(s, d), top_k=TOP_K)


def faulty_measurements(s, d):
    """All tumour measurements with faults planted by sample: bad ids, negative values, duplicate cells."""
    rows = v.tumour(s, d).select("gene_id", "sample_id", "expression_value")
    spoilt = rows.withColumns({
        "gene_id": F.when(F.col("sample_id").endswith("3"), F.concat(F.lit("X"), "gene_id")).otherwise(F.col("gene_id")),
        "expression_value": F.when(F.col("sample_id").endswith("4"), F.lit(-1.0)).otherwise(F.col("expression_value")),
    })
    return spoilt.unionByName(rows.where(F.col("sample_id").endswith("2")))


def overlap_boot(s, d):
    return a_ops.bootstrap_concordance(pairs(s, d), replicates=RUNS, seed=SEED, threshold=0.1, top_k=TOP_K, tie_draws=TIE_DRAWS)


SENS = dict(repeats=3, thresholds=(0.0, 45000.0), pseudocounts=(1.0, 1000.0), scales=(0.1, 1.0), top_k=TOP_K, prevalence=0.5, maximum=12, seed=SEED)


def range_violations(s, d):
    """Faults are planted: a share above 1, a correlation below -1, a weight above 1."""
    of = F.col("cancer_type")
    compared = comparison(s, d).withColumn("top_k_jaccard", F.when((of == "BUILDING") & (F.col("top_k") == 25), F.col("top_k_jaccard") + 1.5).otherwise(F.col("top_k_jaccard"))).withColumn(
        "spearman_abs_effect", F.when(of == "FURNITURE", -1.25).otherwise(F.col("spearman_abs_effect")))
    ablated = ablation(s, d).withColumn("retained_weight", F.when(of == "MACHINERY", F.col("retained_weight") + 1).otherwise(F.col("retained_weight")))
    return a_ops.out_of_range_metrics(compared, ablated)


PAIRED_DRAWS_SQL = f"""
    SELECT * FROM (WITH units AS (SELECT DISTINCT cancer_type, CASE WHEN _arm = 'n' THEN 'n' ELSE 'case' END AS pool, unit_id FROM dense
        WHERE _arm = 'n' OR (cancer_type, unit_id) IN (SELECT cancer_type, unit_id FROM dense WHERE _arm <> 'n' GROUP BY 1, 2 HAVING count(DISTINCT _arm) = 2)),
    sizes AS (SELECT cancer_type, least(12, greatest(2, CAST(floor(min(c) * 0.8::DOUBLE) AS BIGINT))) AS group_size FROM (SELECT cancer_type, pool, count(*) AS c FROM units GROUP BY 1, 2) GROUP BY 1),
    chosen AS (SELECT * FROM (SELECT u.*, repeat::INT AS repeat, row_number() OVER (PARTITION BY cancer_type, repeat, pool ORDER BY md5(concat_ws('|', {SEED}, cancer_type, repeat, pool, unit_id)), unit_id) AS p
        FROM units u, range(0, 3) r(repeat)) JOIN sizes USING (cancer_type) WHERE p <= group_size)
    SELECT cancer_type, repeat, unnest(CASE pool WHEN 'n' THEN ['n'] ELSE ['t', 'a'] END) AS _arm, unit_id, group_size FROM chosen)"""


def sensitivity(s, d):
    return r_ops.development_sensitivity(native_rows(dense(s, d)), **SENS)


v.SQL_VIEWS["sens_rows"] = (("dense",), f"""
    WITH units AS (SELECT DISTINCT cancer_type, _arm, unit_id FROM dense),
    sizes AS (SELECT cancer_type, least(12, greatest(2, CAST(floor(min(c) * 0.8::DOUBLE) AS BIGINT))) AS group_size FROM (SELECT cancer_type, _arm, count(*) AS c FROM units GROUP BY 1, 2) GROUP BY 1),
    chosen AS (SELECT * FROM (SELECT u.*, repeat, row_number() OVER (PARTITION BY cancer_type, repeat, _arm ORDER BY md5(concat_ws('|', {SEED}, cancer_type, repeat, _arm, unit_id)), unit_id) AS p
               FROM units u, range(0, 3) r(repeat)) JOIN sizes USING (cancer_type) WHERE p <= group_size)
    SELECT d.cancer_type, gene_symbol, d._arm, native_value, repeat, group_size FROM dense d JOIN chosen USING (cancer_type, _arm, unit_id)""")
v.SQL_VIEWS["sens_effects"] = (("sens_rows",), sql_effects("sens_rows", "cancer_type, gene_symbol, repeat", "native_value"))
v.SQL_VIEWS["sens_wide"] = (("sens_rows", "sens_effects"), """
    SELECT *, count(*) OVER (PARTITION BY cancer_type, repeat, expression_threshold, pseudocount, scale) AS gene_count,
           abs(log2((median_tumor * scale + pseudocount) / (median_adjacent * scale + pseudocount))) AS adj,
           abs(log2((median_tumor * scale + pseudocount) / (median_gtex * scale + pseudocount))) AS gt,
           abs(log2((median_tumor + pseudocount) / (median_gtex + pseudocount))) AS base,
           abs(log2((median_tumor * scale + pseudocount * scale) / (median_gtex * scale + pseudocount * scale))) AS scaled
    FROM sens_effects JOIN (SELECT cancer_type, gene_symbol, repeat, expression_threshold FROM (
        SELECT cancer_type, gene_symbol, repeat, expression_threshold, _arm, avg((native_value >= expression_threshold)::INT) AS s FROM sens_rows, (VALUES (0.0::DOUBLE), (45000.0)) t(expression_threshold) GROUP BY 1, 2, 3, 4, 5)
        GROUP BY 1, 2, 3, 4 HAVING max(s) >= 0.5) USING (cancer_type, gene_symbol, repeat),
      (VALUES (1.0::DOUBLE), (1000.0)) p(pseudocount), (VALUES (0.1::DOUBLE), (1.0)) c(scale)""")
_SG = "cancer_type, repeat, expression_threshold, pseudocount, scale"
_SR = lambda c: f"row_number() OVER (PARTITION BY {_SG} ORDER BY round({c}, 12) DESC, gene_symbol)"
_SJ = lambda a, b: f"count(*) FILTER ({a} <= top_k AND {b} <= top_k) / count(*) FILTER ({a} <= top_k OR {b} <= top_k)"
v.SQL_VIEWS["sensitivity"] = (("sens_wide", "sens_rows"), f"""
    SELECT {_SG}, top_k, gene_count, group_size, {_SJ('r1', 'r2')} AS reference_jaccard, {_SJ('r3', 'r4')} AS rank_biserial_reference_jaccard, {_SJ('r5', 'r2')} AS fixed_pseudocount_scale_jaccard,
           {_SJ('r5', 'r6')} AS scaled_pseudocount_scale_jaccard, corr(ma, mg) AS abs_effect_spearman
    FROM (SELECT *, {_SR('adj')} AS r1, {_SR('gt')} AS r2, {_SR('abs(adjacent)')} AS r3, {_SR('abs(gtex)')} AS r4, {_SR('base')} AS r5, {_SR('scaled')} AS r6,
                 {v.sql_midrank('adj', _SG)} AS ma, {v.sql_midrank('gt', _SG)} AS mg FROM sens_wide WHERE gene_count >= 10)
    JOIN (SELECT DISTINCT cancer_type, group_size FROM sens_rows) USING (cancer_type), (VALUES (5::BIGINT), (10)) k(top_k) GROUP BY {_SG}, top_k, gene_count, group_size""")

K = ["cancer_type", "gene_symbol"]
QUERIES = {
    "bootstrap_candidate_selection": selection,
    "bootstrap_stability": lambda s, d: rounded(bootstrap.fresh(s, d)),
    "consensus_candidates": lambda s, d: rounded(consensus.fresh(s, d), 9),
    "consensus_tier_counts": lambda s, d: s_ops.label_counts(consensus(s, d), "consensus_decision", "publication_tier"),
    "reference_method_comparison": comparison.fresh,
    "consensus_component_ablation": ablation.fresh,
    "evaluation_range_violations": range_violations,
    "sensitivity_paired_draws": lambda s, d: r_ops.subsamples(native_rows(dense(s, d)), repeats=3, maximum=12, seed=SEED, paired=True),
    "study_sample_index": index.fresh,
    "study_ambiguous_samples": lambda s, d: r_ops.ambiguous_samples(all_index(s, d)),
    "study_grouped_partition": split.fresh,
    "study_global_partition": global_split,
    "study_leaking_units": lambda s, d: r_ops.leaking_units(split(s, d)),
    "study_balanced_units": balanced.fresh,
    "study_paired_units": paired_balanced,
    "study_partition_audit": lambda s, d: r_ops.partition_audit(index(s, d), global_split(s, d), balanced(s, d)),
    "study_measurement_violations": lambda s, d: r_ops.measurement_violations(faulty_measurements(s, d)),
    "contrast_effects": lambda s, d: rounded(dense_effects(s, d)),
    "scaled_fold_change": lambda s, d: dense_effects(s, d).select(
        *K, F.round(r_ops.fold_change(pseudocount=1.0, scale=10.0, scale_pseudocount=True), 6).alias("scaled_offset_fc"),
        F.round(r_ops.fold_change(pseudocount=1.0, scale=10.0), 6).alias("fixed_offset_fc")),
    "prevalence_filter": lambda s, d: rounded(r_ops.prevalence_mask(native_rows(dense(s, d)), threshold=50000.0, prevalence=0.5)),
    "ranking_scores": lambda s, d: rounded(r_ops.ranking_scores(dense_effects(s, d))),
    "published_rank_aggregation": lambda s, d: rounded(r_ops.published_rra(_train_base(s, d))),
    "cluster_bootstrap_draws": lambda s, d: r_ops.cluster_draws(_side(s, d, "development"), replicates=RUNS, seed=SEED),
    "resampled_effects": lambda s, d: rounded(train_effects.fresh(s, d)),
    "stability_lower_quantile": lambda s, d: rounded(r_ops.stability_scores(train_effects(s, d))),
    "training_candidates": lambda s, d: rounded(r_ops.training_candidates(study_scores(s, d), TOP_K)),
    "holdout_evaluation": lambda s, d: rounded(r_ops.holdout_evaluation(study_scores(s, d), test_effects(s, d), top_k=TOP_K), 9),
    "holdout_published_ranking": lambda s, d: rounded(r_ops.rra_evaluation(study_scores(s, d), r_ops.published_rra(_train_base(s, d)), _train_base(s, d), test_effects(s, d), top_k=TOP_K), 9),
    "development_sensitivity": lambda s, d: rounded(sensitivity(s, d)),
    "specimen_crosswalk": crosswalk,
    "matched_manifest": lambda s, d: a_ops.matched_manifest(*_manifest_inputs(s, d)),
    "matched_manifest_summary": lambda s, d: a_ops.manifest_summary(*_manifest_inputs(s, d)),
    "pipeline_pairs": lambda s, d: rounded(pairs.fresh(s, d)),
    "specimen_agreement": lambda s, d: rounded(specimens.fresh(s, d)),
    "cohort_agreement": lambda s, d: rounded(a_ops.cohort_agreement(specimens(s, d), metrics=("spearman_all_common", "top100_jaccard"), replicates=RUNS, seed=SEED)),
    "effect_rank_overlap": lambda s, d: rounded(a_ops.effect_rank_overlap(pairs(s, d), top_k=TOP_K)),
    "informative_genes": lambda s, d: rounded(a_ops.informative_genes(pairs(s, d), prevalence=0.9)),
    "detection_discordance": lambda s, d: a_ops.detection_discordance(pairs(s, d)),
    "kendall_tau_b": lambda s, d: rounded(a_ops.kendall_tau_b(effects(s, d), ["cancer_type"], "native_effect", "recount_effect")),
    "direction_agreement": lambda s, d: rounded(a_ops.direction_agreement(effects(s, d))),
    "effect_distribution": lambda s, d: rounded(a_ops.effect_distribution(effects(s, d))),
    "tie_aware_overlap": lambda s, d: rounded(a_ops.tie_overlap(effects(s, d), top_k=TOP_K, draws=TIE_DRAWS, seed=SEED)),
    "bootstrap_concordance": lambda s, d: rounded(overlap_boot(s, d)[0]),
    "bootstrap_tie_overlap": lambda s, d: rounded(overlap_boot(s, d)[1]),
    "annotation_audit": lambda s, d: a_ops.annotation_audit(
        v.tumour(s, d).withColumnRenamed("project_id", "cancer_type"),
        v.reference(s, d).join(v.cohorts(s), "tissue_site").withColumn("gene_symbol", F.regexp_replace("gene_symbol", "PROMO", "PROMOTED"))),
    "nested_hash_sample": lambda s, d: a_ops.nested_sample(specimen_manifest(s, d), seed=SEED, maximum=30, check=False),
    "tables_within_tolerance": lambda s, d: rounded(a_ops.tables_close(
        dense(s, d).select("cancer_type", "sample_id", "gene_symbol", "native_value"),
        panel(s, d).groupBy("cancer_type", "sample_id", F.substring_index("gene_symbol", "_", 1).alias("gene_symbol")).agg(F.min("native_value").alias("native_value")),
        ["cancer_type", "sample_id", "gene_symbol"])),
    "ranking_truth_metrics": lambda s, d: rounded(truth_metrics.fresh(s, d)),
    "paired_precision_gain": lambda s, d: rounded(a_ops.paired_precision(truth_metrics(s, d), proposed=r_ops.STABILITY)),
    "study_rollup": lambda s, d: rounded(a_ops.study_rollup({
        "native": r_ops.holdout_evaluation(study_scores(s, d), test_effects(s, d), top_k=TOP_K),
        "strict": r_ops.holdout_evaluation(study_scores(s, d), test_effects(s, d), top_k=TOP_K, threshold=0.1)}, k=5)),
    "study_truth_means": lambda s, d: rounded(a_ops.truth_means(truth_metrics(s, d))),
}

_EVAL = "proposed_minus_baseline_replication_fraction"
v.SQL_VIEWS["evaluation_loose"] = (("tops", "test_effects"), _evaluation_sql("tops").replace(">= 0.3", ">= 0.1"))
BOOT_DOUBLES = (
    "tcga_direction_stability gtex_direction_stability reference_concordance_rate opposite_direction_rate tcga_top_k_selection_rate gtex_top_k_selection_rate "
    "tcga_median_rank tcga_rank_ci_low tcga_rank_ci_high gtex_median_rank gtex_rank_ci_low gtex_rank_ci_high tcga_median_log2_fc tcga_log2_fc_ci_low tcga_log2_fc_ci_high "
    "gtex_median_log2_fc gtex_log2_fc_ci_low gtex_log2_fc_ci_high rank_precision bootstrap_stability_score"
)
EFFECT_DOUBLES = "adjacent gtex median_tumor median_adjacent median_gtex"
_CI = lambda c, run: f"round(max({c}) FILTER (replicate = -1), 6) AS {c}, round(quantile_cont({c}, 0.025) FILTER (replicate >= 0), 6) AS {c}_bootstrap_ci_low, round(quantile_cont({c}, 0.975) FILTER (replicate >= 0), 6) AS {c}_bootstrap_ci_high"

SQL = {
    "bootstrap_candidate_selection": v.sql("SELECT * FROM selection", "selection"),
    "bootstrap_stability": v.sql(v.rounds(BOOT_DOUBLES, "(SELECT * EXCLUDE (score) FROM bootstrap)"), "bootstrap"),
    "consensus_candidates": v.sql(v.rounds(CONSENSUS_DOUBLES, "consensus", 9), "consensus"),
    "consensus_tier_counts": v.sql("SELECT consensus_decision, publication_tier, count(*) AS row_count FROM consensus GROUP BY 1, 2", "consensus"),
    "reference_method_comparison": v.sql("SELECT * FROM comparison", "comparison"),
    "consensus_component_ablation": v.sql("SELECT * FROM ablation", "ablation"),
    "sensitivity_paired_draws": v.sql(PAIRED_DRAWS_SQL, "dense"),
    "evaluation_range_violations": v.sql("""SELECT * FROM (WITH compared AS (SELECT * REPLACE (CASE WHEN cancer_type = 'BUILDING' AND top_k = 25 THEN top_k_jaccard + 1.5 ELSE top_k_jaccard END AS top_k_jaccard,
            CASE WHEN cancer_type = 'FURNITURE' THEN -1.25 ELSE spearman_abs_effect END AS spearman_abs_effect) FROM comparison),
        ablated AS (SELECT * REPLACE (CASE WHEN cancer_type = 'MACHINERY' THEN retained_weight + 1 ELSE retained_weight END AS retained_weight) FROM ablation)
        SELECT 'comparison' AS mart, cancer_type, method_a || '/' || method_b AS item, top_k FROM compared
        WHERE NOT (top_k_jaccard BETWEEN 0 AND 1) OR NOT (spearman_abs_effect BETWEEN -1 AND 1) OR median_abs_effect_delta < 0 OR top_k_overlap_count > top_k
        UNION ALL SELECT 'ablation', cancer_type, ablation_scenario, top_k FROM ablated WHERE NOT (top_k_jaccard BETWEEN 0 AND 1) OR retained_weight > 1)""", "comparison", "ablation"),
    "study_sample_index": v.sql("SELECT * FROM index", "index"),
    "study_ambiguous_samples": v.sql("""SELECT 'TCGA' AS source, project_id AS cancer_type, sample_id, count(DISTINCT (case_id, sample_type)) AS owners FROM tumour GROUP BY 1, 2, 3 HAVING count(DISTINCT (case_id, sample_type)) > 1""", "tumour"),
    "study_grouped_partition": v.sql("SELECT * FROM split", "split"),
    "study_global_partition": v.sql("SELECT * FROM global_split", "global_split"),
    "study_leaking_units": v.sql("SELECT source, unit_id, count(DISTINCT partition) AS partitions FROM split GROUP BY 1, 2 HAVING count(DISTINCT partition) > 1", "split"),
    "study_balanced_units": v.sql("SELECT * FROM balanced", "balanced"),
    "study_paired_units": v.sql("SELECT * FROM paired_balanced", "paired_balanced"),
    "study_partition_audit": v.sql("""SELECT a.cancer_type, a.partition, a."group", available_count, coalesce(selected_count, 0) AS selected_count, coalesce(shared_case_count, 0) AS shared_case_count,
        (SELECT count(*) FROM (SELECT source, unit_id FROM global_split GROUP BY 1, 2 HAVING count(DISTINCT partition) > 1)) AS global_leakage_count,
        CASE WHEN coalesce(selected_count, 0) > 0 THEN 'completed' ELSE 'insufficient_units' END AS status
        FROM (SELECT cancer_type, partition, "group", count(*) AS available_count FROM global_split GROUP BY 1, 2, 3) a
        LEFT JOIN (SELECT cancer_type, partition, "group", count(*) AS selected_count FROM balanced GROUP BY 1, 2, 3) b ON a.cancer_type = b.cancer_type AND a.partition = b.partition AND a."group" = b."group"
        LEFT JOIN (SELECT cancer_type, partition, count(*) AS shared_case_count FROM (SELECT cancer_type, partition, unit_id FROM balanced WHERE "group" <> 'gtex' GROUP BY 1, 2, 3 HAVING count(DISTINCT "group") = 2) GROUP BY 1, 2) c
          ON a.cancer_type = c.cancer_type AND a.partition = c.partition""", "global_split", "balanced"),
    "study_measurement_violations": v.sql("""SELECT * FROM (WITH faulty AS (
          SELECT CASE WHEN sample_id LIKE '%3' THEN 'X' || gene_id ELSE gene_id END AS gene_id, sample_id, CASE WHEN sample_id LIKE '%4' THEN -1 ELSE expression_value END AS expression_value FROM tumour
          UNION ALL SELECT gene_id, sample_id, expression_value FROM tumour WHERE sample_id LIKE '%2')
        SELECT coalesce(sum(n) FILTER (NOT regexp_matches(g, '^ENSG[0-9]+(_PAR_Y)?$')), 0)::BIGINT AS invalid_gene_ids, sum(bad)::BIGINT AS invalid_values, count(*) FILTER (n > 1) AS duplicate_cells
        FROM (SELECT gene_id AS g, sample_id, count(*) AS n, count(*) FILTER (expression_value IS NULL OR expression_value < 0) AS bad FROM faulty GROUP BY 1, 2))""", "tumour"),
    "contrast_effects": v.sql(v.rounds(EFFECT_DOUBLES, "dense_effects"), "dense_effects"),
    "scaled_fold_change": v.sql("""SELECT cancer_type, gene_symbol, round(log2((median_tumor * 10 + 10) / (median_gtex * 10 + 10)), 6) AS scaled_offset_fc,
        round(log2((median_tumor * 10 + 1) / (median_gtex * 10 + 1)), 6) AS fixed_offset_fc FROM dense_effects""", "dense_effects"),
    "prevalence_filter": v.sql("""SELECT cancer_type, gene_symbol, round(max(s), 6) AS max_share FROM (SELECT cancer_type, gene_symbol, _arm, avg((native_value >= 50000)::INT) AS s FROM dense GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max(s) >= 0.5""", "dense"),
    "ranking_scores": v.sql(v.rounds("score", "dense_scores"), "dense_scores"),
    "published_rank_aggregation": v.sql(v.rounds("rra_score", "(SELECT * EXCLUDE (adjacent, gtex) FROM published)"), "published"),
    "cluster_bootstrap_draws": v.sql("SELECT cancer_type, _pool, replicate, unit_id, count(*) AS times FROM train_draws GROUP BY ALL", "train_draws"),
    "resampled_effects": v.sql(v.rounds(EFFECT_DOUBLES, "train_effects"), "train_effects"),
    "stability_lower_quantile": v.sql(v.rounds("score", "study_scores") + f" WHERE method = '{r_ops.STABILITY}'", "study_scores"),
    "training_candidates": v.sql(v.rounds("score", "(SELECT * EXCLUDE (top_k) FROM tops WHERE top_k = 10)"), "tops"),
    "holdout_evaluation": v.sql(v.rounds(EVALUATION_DOUBLES, "evaluation", 9), "evaluation"),
    "holdout_published_ranking": v.sql(v.rounds(EVALUATION_DOUBLES + " discordant_reference_direction_fraction rra_style_topk_jaccard", "rra_evaluation", 9), "rra_evaluation"),
    "development_sensitivity": v.sql(v.rounds("reference_jaccard rank_biserial_reference_jaccard fixed_pseudocount_scale_jaccard scaled_pseudocount_scale_jaccard abs_effect_spearman", "sensitivity"), "sensitivity"),
    "specimen_crosswalk": v.sql("""SELECT source, cohort, count(*) AS recount3_samples, count(*) FILTER (c = 1 AND native_unit_id IS NOT NULL) AS exact_specimen_matches,
        count(*) FILTER (c > 1) AS excluded_duplicate_specimen_files, count(DISTINCT CASE WHEN c > 1 THEN specimen_id END) AS excluded_duplicate_specimens,
        count(*) FILTER (c = 1 AND native_unit_id IS NULL) AS unmatched_recount3_samples, round(count(*) FILTER (c = 1 AND native_unit_id IS NOT NULL) / count(*), 6) AS match_fraction_of_all_selected,
        count(*) FILTER (specimen_id IS NULL) AS missing_metadata, 0::BIGINT AS ambiguous_native, count(*) FILTER (c = 1 AND native_unit_id <> unit_id) AS unit_conflicts, count(*) FILTER (access <> 'open') AS closed_access
        FROM (SELECT *, count(*) OVER (PARTITION BY source, cohort, specimen_id) AS c FROM cw_selected JOIN cw_metadata USING (sample_id)) LEFT JOIN cw_native USING (specimen_id) GROUP BY 1, 2""", "cw_selected", "cw_metadata", "cw_native"),
    "matched_manifest": v.sql("SELECT * FROM mm_matched", "mm_matched"),
    "matched_manifest_summary": v.sql("""SELECT source, cohort, invalid_qc_rows, coalesce(e, 0) AS eligible_metadata_rows, coalesce(dup, 0) AS excluded_duplicate_specimens, coalesce(f, 0) AS excluded_duplicate_specimen_files, coalesce(m, 0) AS matched_samples
        FROM (SELECT source, cohort, count(*) FILTER (auc <= 0) AS invalid_qc_rows FROM mm_meta GROUP BY 1, 2)
        LEFT JOIN (SELECT source, cohort, count(*) AS e, count(DISTINCT CASE WHEN c > 1 THEN specimen_id END) AS dup, count(*) FILTER (c > 1) AS f FROM mm_good GROUP BY 1, 2) USING (source, cohort)
        LEFT JOIN (SELECT source, cohort, count(*) AS m FROM mm_matched GROUP BY 1, 2) USING (source, cohort)""", "mm_meta", "mm_good", "mm_matched"),
    "pipeline_pairs": v.sql(v.rounds("native_value recount_value", "pipeline_pairs"), "pipeline_pairs"),
    "specimen_agreement": v.sql(v.rounds("top100_jaccard spearman_all_common spearman_jointly_detected", "specimens"), "specimens"),
    "cohort_agreement": v.sql("""SELECT cancer_type, _arm, metric, matched_specimens, biological_units, round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
        FROM (SELECT cancer_type, _arm, metric, count(*) AS matched_specimens, count(DISTINCT unit_id) AS biological_units, median(x) AS median, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75 FROM agreement_long WHERE x IS NOT NULL GROUP BY 1, 2, 3)
        JOIN (SELECT cancer_type, _arm, metric, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
          SELECT cancer_type, _arm, metric, replicate, median(x) AS m FROM agreement_long JOIN agreement_draws USING (cancer_type, _arm, metric, unit_id) WHERE replicate >= 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) USING (cancer_type, _arm, metric)""",
        "agreement_long", "agreement_draws"),
    "effect_rank_overlap": v.sql(f"""SELECT * FROM (WITH p AS (SELECT *, row_number() OVER (PARTITION BY cancer_type ORDER BY abs(native_effect) DESC, gene_symbol) AS a, row_number() OVER (PARTITION BY cancer_type ORDER BY abs(recount_effect) DESC, gene_symbol) AS b FROM complete_effects)
        SELECT cancer_type, top_k, round(count(*) FILTER (a <= top_k AND b <= top_k) / count(*) FILTER (a <= top_k OR b <= top_k), 6) AS top_k_jaccard, count(*) FILTER (a <= top_k AND b <= top_k) AS shared_top_genes,
               round(count(*) FILTER (a <= top_k AND b <= top_k AND sign(native_effect) = sign(recount_effect)) / nullif(count(*) FILTER (a <= top_k AND b <= top_k), 0), 6) AS direction_agreement_shared_top,
               native_boundary_ties AS native_boundary_tie_count, recount_boundary_ties AS recount_boundary_tie_count, matched_tumor_specimens, matched_normal_specimens, complete_common_genes
        FROM p CROSS JOIN (VALUES (5::BIGINT), (10)) k(top_k) JOIN ({_ties_sql('complete_effects', 'cancer_type')}) USING (cancer_type, top_k)
        JOIN (SELECT cancer_type, count(DISTINCT sample_id) FILTER (_arm = 't') AS matched_tumor_specimens, count(DISTINCT sample_id) FILTER (_arm = 'n') AS matched_normal_specimens,
                     count(DISTINCT gene_symbol) AS complete_common_genes FROM complete_pairs GROUP BY 1) USING (cancer_type)
        GROUP BY ALL)""", "complete_effects", "complete_pairs"),
    "informative_genes": v.sql("""SELECT cancer_type, gene_symbol, round(min(least(a, b)), 6) AS lowest_detection FROM (SELECT cancer_type, gene_symbol, _arm, avg((native_value > 0)::INT) AS a, avg((recount_value > 0)::INT) AS b
        FROM pipeline_pairs GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING min(least(a, b)) >= 0.9""", "pipeline_pairs"),
    "detection_discordance": v.sql("SELECT cancer_type, _arm, count(*) FILTER ((native_value > 0) <> (recount_value > 0)) AS detection_discordant_cells, count(*) AS detection_cells FROM pipeline_pairs GROUP BY 1, 2", "pipeline_pairs"),
    "kendall_tau_b": v.sql(f"SELECT cancer_type, round(kendall_tau_b, 6) AS kendall_tau_b FROM ({_tau_sql('pipeline_effects', 'cancer_type')})", "pipeline_effects"),
    "direction_agreement": v.sql(f"SELECT cancer_type, direction_denominator, round(direction_agreement, 6) AS direction_agreement FROM ({_direction_sql('pipeline_effects', 'cancer_type')})", "pipeline_effects"),
    "effect_distribution": v.sql("""SELECT cancer_type, pipeline, count(*) FILTER (x = 0) AS zero_effect_genes, count(*) FILTER (abs(abs(x) - 1) <= 1e-12 + 1e-5) AS saturated_effect_genes, round(median(abs(x)), 6) AS median_absolute_effect,
        round(quantile_cont(abs(x), 0.25), 6) AS q25_absolute_effect, round(quantile_cont(abs(x), 0.75), 6) AS q75_absolute_effect
        FROM (SELECT cancer_type, unnest([{'pipeline': 'native', 'x': native_effect}, {'pipeline': 'recount3', 'x': recount_effect}], recursive := true) FROM pipeline_effects) GROUP BY 1, 2""", "pipeline_effects"),
    "tie_aware_overlap": v.sql(v.rounds("deterministic_jaccard tie_mean_jaccard tie_q025_jaccard tie_q975_jaccard", f"({_ties_sql('pipeline_effects', 'cancer_type')})"), "pipeline_effects"),
    "bootstrap_concordance": v.sql(f"""SELECT cancer_type, {_CI('kendall_tau_b', 0)}, {_CI('direction_agreement', 0)}, count(*) FILTER (replicate >= 0) AS bootstrap_replicates
        FROM ({_tau_sql('boot_pipe_effects', 'cancer_type, replicate')}) JOIN ({_direction_sql('boot_pipe_effects', 'cancer_type, replicate')}) USING (cancer_type, replicate) GROUP BY 1""", "boot_pipe_effects"),
    "bootstrap_tie_overlap": v.sql(f"SELECT cancer_type, top_k, {_CI('tie_mean_jaccard', 0)}, count(*) FILTER (replicate >= 0) AS bootstrap_replicates FROM ({_ties_sql('boot_pipe_effects', 'cancer_type, replicate')}) GROUP BY 1, 2", "boot_pipe_effects"),
    "annotation_audit": v.sql("""SELECT cancer_type, count(a) AS native_gene_ids, count(b) AS recount_gene_ids, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared_gene_ids,
        count(*) FILTER (b IS NULL) AS native_only_gene_ids, count(*) FILTER (a IS NULL) AS recount_only_gene_ids, count(*) FILTER (len(a) > 1) AS native_multi_symbol_gene_ids, count(*) FILTER (len(b) > 1) AS recount_multi_symbol_gene_ids,
        count(*) FILTER (a <> b) AS shared_symbol_conflicts, count(*) FILTER (a IS NOT NULL AND gene_id LIKE '%\\_PAR\\_Y' ESCAPE '\\') AS native_par_y_genes, count(*) FILTER (b IS NOT NULL AND gene_id LIKE '%\\_PAR\\_Y' ESCAPE '\\') AS recount_par_y_genes
        FROM (SELECT project_id AS cancer_type, gene_id, list_sort(list(DISTINCT gene_symbol)) AS a FROM tumour GROUP BY 1, 2)
        FULL JOIN (SELECT cancer_type, gene_id, list_sort(list(DISTINCT replace(gene_symbol, 'PROMO', 'PROMOTED'))) AS b FROM mapped_reference GROUP BY 1, 2) USING (cancer_type, gene_id) GROUP BY 1""", "tumour", "mapped_reference"),
    "nested_hash_sample": v.sql(f"""SELECT source, cohort, tissue_site, unit_id, recount_sample_id, nested_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY source, cohort, tissue_site ORDER BY h, recount_sample_id) AS nested_rank FROM (
          SELECT 'TCGA' AS source, project_id AS cohort, sample_type AS tissue_site, case_id AS unit_id, sample_id AS recount_sample_id, sha256(concat_ws('|', {SEED}, 'TCGA', case_id, sample_id)) AS h
          FROM (SELECT DISTINCT project_id, sample_type, case_id, sample_id FROM tumour)
          QUALIFY row_number() OVER (PARTITION BY project_id, sample_type, case_id ORDER BY sha256(concat_ws('|', {SEED}, 'TCGA', case_id, sample_id)), sample_id) = 1))
        WHERE nested_rank <= 30""", "tumour"),
    "tables_within_tolerance": v.sql("""SELECT 'native_value' AS column_name, count(*) FILTER (x IS NULL OR y IS NULL) AS unmatched_keys, round(max(abs(x - y)), 6) AS max_absolute_difference,
        count(*) FILTER (abs(x - y) > abs(y) * 1e-10 + 1e-12) AS cells_outside_tolerance, count(*) FILTER (x IS NULL OR y IS NULL) = 0 AND count(*) FILTER (abs(x - y) > abs(y) * 1e-10 + 1e-12) = 0 AS comparable
        FROM (SELECT cancer_type, sample_id, gene_symbol, native_value AS x FROM dense) FULL JOIN (SELECT cancer_type, sample_id, split_part(gene_symbol, '_', 1) AS gene_symbol, min(native_value) AS y FROM panel GROUP BY 1, 2, 3)
        USING (cancer_type, sample_id, gene_symbol)""", "dense", "panel"),
    "ranking_truth_metrics": v.sql(v.rounds("precision_at_k recall_at_k average_precision", "(SELECT * EXCLUDE (recall_n) FROM truth)"), "truth"),
    # the t quantile by halving an angle: the share of the density c * cos(u)^(df - 1) below it, by the midpoint rule
    "paired_precision_gain": v.sql(f"""SELECT * FROM (WITH RECURSIVE gains AS (SELECT b.top_k, b.method AS baseline, avg(p.precision_at_k - b.precision_at_k) AS m, stddev_samp(p.precision_at_k - b.precision_at_k) AS sd, count(*) AS n
          FROM truth b JOIN truth p ON p.method = '{r_ops.STABILITY}' AND p.repetition = b.repetition AND p.top_k = b.top_k WHERE b.method <> '{r_ops.STABILITY}' GROUP BY 1, 2),
        halving(df, low, high, step) AS (
          SELECT DISTINCT n - 1, 0::DOUBLE, pi() / 2, 0 FROM gains WHERE n > 1
          UNION ALL SELECT df, CASE WHEN share < 0.95 THEN middle ELSE low END, CASE WHEN share < 0.95 THEN high ELSE middle END, step + 1 FROM (
            SELECT *, list_sum(list_transform(range(4000), lambda i: pow(cos(middle * (i + 0.5) / 4000), df - 1))) * middle
                      / (list_sum(list_transform(range(4000), lambda i: pow(cos(pi() / 2 * (i + 0.5) / 4000), df - 1))) * pi() / 2) AS share
            FROM (SELECT *, (low + high) / 2 AS middle FROM halving WHERE step < 45))),
        quantiles AS (SELECT df, sqrt(df) * tan((low + high) / 2) AS t FROM halving WHERE step = 45)
        SELECT 'all' AS scenario, top_k, baseline, round(m, 6) AS mean_precision_difference, round(m - t * sd / sqrt(n), 6) AS monte_carlo_mean_ci_low, round(m + t * sd / sqrt(n), 6) AS monte_carlo_mean_ci_high
        FROM gains LEFT JOIN quantiles ON df = n - 1)""", "truth"),
    "study_rollup": v.sql(f"""SELECT study_id, cancer_type, round({_EVAL}, 6) AS {_EVAL}, round({_EVAL}_ci_low, 6) AS {_EVAL}_ci_low, round({_EVAL}_ci_high, 6) AS {_EVAL}_ci_high FROM (
        SELECT 'native' AS study_id, * FROM evaluation UNION ALL BY NAME SELECT 'strict' AS study_id, * FROM evaluation_loose) WHERE method = 'reference_maximin' AND top_k = 5""", "evaluation", "evaluation_loose"),
    "study_truth_means": v.sql("SELECT scenario, method, top_k, round(avg(precision_at_k), 6) AS precision_at_k FROM truth GROUP BY 1, 2, 3", "truth"),
}
