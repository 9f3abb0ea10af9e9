"""Adapters from the star-schema tables to the engine's table shapes.

Spark view and SQL text of each adapter stand side by side. Every adapter reads
its whole source tables; the SQL of a registered query is ``sql(body, names)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.functions.domain import cohort_map
from contrastry.plans.warehouse import mart, reads, selection

# Market segments standing in for cohorts; one tissue serves two cohorts.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
COHORT_TISSUES = tuple((s, f"{s} tissue") for s in SEGMENTS) + (("BUILDING", "MACHINERY tissue"),)
EVENT_COHORTS = (("signup", "AUTOMOBILE"), ("error", "BUILDING"), ("view", "FURNITURE"), ("click", "HOUSEHOLD"), ("purchase", "MACHINERY"))
PART_TYPES = ("SMALL", "PROMO", "STANDARD", "ECONOMY", "MEDIUM", "LARGE")
VARIANT_CLASSES = (
    "Missense_Mutation", "Silent", "Nonsense_Mutation", "In_Frame_Del", "Frame_Shift_Ins", "Intron", "Splice_Site",
    "missense mutation", "Start_Codon_SNP", "Mystery",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    reads(spark, path)
    return spark.read.parquet(path)


def cohorts(spark: SparkSession) -> DataFrame:
    return cohort_map(spark, COHORT_TISSUES)


@mart("measurements")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: cohort, case, sample, arm (A/R/N), gene and two values.

    Joined once and stored: every table of measurements is a selection of it, and no copy.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("C"), F.col("o_custkey")).alias("case_id"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("cohort"))
    number = F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 3, "0")
    # names are put together once for each part, not for each line
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("ENSG"), number, F.ascii(F.substring("p_type", 2, 1))).alias("gene_id"),
        F.upper(F.concat("p_brand", F.lit("_"), "p_type")).alias("gene_symbol"),
    )
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.select(
        "cohort", "case_id",
        F.concat(F.lit("S"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("sample_id"),
        F.col("l_returnflag").alias("arm"), "gene_id", "gene_symbol",
        F.col("l_extendedprice").alias("value"),
        (F.col("l_quantity") * (F.lit(1.0) - F.col("l_discount"))).alias("alt_value"),
        F.when(F.col("l_linenumber") == 7, "demo/stub").when(F.col("l_linenumber") == 6, "").otherwise("public/star").alias("data_origin"),
    )


@selection
def tumour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).where(F.col("arm") != "N").select(
        F.col("cohort").alias("project_id"), "case_id", "sample_id",
        F.when(F.col("arm") == "A", "Primary Tumor").otherwise("Solid Tissue Normal").alias("sample_type"),
        "gene_id", "gene_symbol", F.col("value").alias("expression_value"), F.lit("TPM").alias("expression_unit"),
        F.lit("STAR - Counts").alias("pipeline_workflow"), "data_origin",
    )


@selection
def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).where(F.col("arm") == "N").select(
        F.col("sample_id").alias("gtex_sample_id"), F.col("case_id").alias("donor_id"),
        F.concat("cohort", F.lit(" tissue")).alias("tissue_site"), "gene_id", "gene_symbol",
        F.col("value").alias("expression_value"), F.lit("TPM").alias("expression_unit"), "data_origin",
    )


@selection
def reprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).where(F.col("arm") != "R")
    normal = F.col("arm") == "N"
    return m.select(
        F.when(normal, "GTEX").otherwise("TCGA").alias("source"),
        F.when(normal, "").otherwise(F.col("cohort")).alias("project_id"),
        F.concat("sample_id", F.lit(".1")).alias("sample_id"),
        F.when(normal, "Normal").otherwise("Primary Tumor").alias("sample_type"),
        F.when(normal, F.concat("cohort", F.lit(" tissue"))).otherwise("").alias("tissue_site"),
        "gene_id", "gene_symbol", F.col("alt_value").alias("expression_value"), F.lit("G029").alias("external_annotation"),
    )


@mart("mutations")
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    cohort = F.create_map(*[F.lit(x) for pair in EVENT_COHORTS for x in pair])[F.col("event_type")]
    classes, types = (F.array(*[F.lit(x) for x in xs]) for xs in (VARIANT_CLASSES, PART_TYPES))
    e = events.withColumn("k", k)
    k = F.col("k")

    def pick(arr, n):
        return F.element_at(arr, (F.pmod(k, F.lit(n)) + 1).cast("int"))

    return e.select(
        cohort.alias("project_id"),
        F.concat(F.lit("C"), F.col("user_id")).alias("case_id"),
        F.concat(F.lit("S"), F.col("user_id")).alias("sample_id"),
        F.concat(F.lit("BRAND#"), F.pmod(k, F.lit(25)) + 1, F.lit("_"), pick(types, 6)).alias("gene_symbol"),
        pick(classes, 10).alias("variant_classification"),
        F.when(F.pmod(k, F.lit(11)) == 0, "Unknown").otherwise("GRCh38").alias("reference_assembly"),
        F.concat(F.lit("chr"), F.pmod(k, F.lit(5))).alias("chromosome"),
        (k + F.pmod(F.col("event_id"), F.lit(3)) * 1000).alias("start_position"),
        F.lit("A").alias("reference_allele"),
        F.when(F.pmod(k, F.lit(2)) == 0, "T").otherwise("G").alias("tumor_seq_allele"),
        F.when(F.pmod(k, F.lit(4)) == 0, " ").otherwise(F.concat(F.lit(" ENST"), F.pmod(k, F.lit(4)))).alias("transcript_id"),
        pick(classes, 3).alias("vep_consequence"),
        F.when(F.pmod(k, F.lit(3)) == 0, " high").when(F.pmod(k, F.lit(3)) == 1, "Low ").alias("vep_impact"),
        F.when(F.pmod(k, F.lit(3)) > 0, "c.1A>G").alias("hgvsc"),
        F.when(F.pmod(k, F.lit(4)) > 0, "p.K1N").otherwise(" ").alias("hgvsp"),
        F.when(F.pmod(k, F.lit(5)) == 0, "x").alias("all_effects"),
        F.when(F.pmod(k, F.lit(9)) == 0, "placeholder").otherwise("public/maf").alias("data_origin"),
    )


@mart("profile")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiled samples: those with events, plus every user under a cohort without events."""
    m = mutations(spark, sf_dir).select("project_id", "sample_id").distinct()
    silent = m.select(F.lit("NO-EVENT").alias("project_id"), "sample_id").distinct()
    return m.unionByName(silent)


@mart("gene_sets")
def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("SET_"), F.col("p_size")).alias("pathway_id"),
        F.concat(F.lit("Set "), F.col("p_size")).alias("pathway_name"),
        F.lit("Reactome").alias("pathway_source"),
        F.upper(F.concat("p_brand", F.lit("_"), "p_type")).alias("gene_symbol"),
    ).distinct()


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "cohorts": ((), "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in COHORT_TISSUES) + ") v(cancer_type, tissue_site)"),
    "measurements": ((), """
        SELECT c_mktsegment AS cohort, 'C' || o_custkey AS case_id, 'S' || l_orderkey || '-' || l_linenumber AS sample_id,
               l_returnflag AS arm,
               'ENSG' || lpad(regexp_extract(p_brand, '(\\d+)', 1), 3, '0') || ascii(substr(p_type, 2, 1)) AS gene_id,
               upper(p_brand || '_' || p_type) AS gene_symbol,
               l_extendedprice AS value, l_quantity * (1.0::DOUBLE - l_discount) AS alt_value,
               CASE WHEN l_linenumber = 7 THEN 'demo/stub' WHEN l_linenumber = 6 THEN '' ELSE 'public/star' END AS data_origin
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN part ON l_partkey = p_partkey"""),
    "tumour": (("measurements",), """
        SELECT cohort AS project_id, case_id, sample_id,
               CASE WHEN arm = 'A' THEN 'Primary Tumor' ELSE 'Solid Tissue Normal' END AS sample_type,
               gene_id, gene_symbol, value AS expression_value, data_origin
        FROM measurements WHERE arm <> 'N'"""),
    "reference": (("measurements",), """
        SELECT sample_id AS gtex_sample_id, case_id AS donor_id, cohort || ' tissue' AS tissue_site, gene_id, gene_symbol,
               value AS expression_value, data_origin
        FROM measurements WHERE arm = 'N'"""),
    "reprocessed": (("measurements",), """
        SELECT CASE WHEN arm = 'N' THEN 'GTEX' ELSE 'TCGA' END AS source,
               CASE WHEN arm = 'N' THEN '' ELSE cohort END AS project_id, sample_id || '.1' AS sample_id,
               CASE WHEN arm = 'N' THEN 'Normal' ELSE 'Primary Tumor' END AS sample_type,
               CASE WHEN arm = 'N' THEN cohort || ' tissue' ELSE '' END AS tissue_site,
               gene_id, gene_symbol, alt_value AS expression_value, 'G029' AS external_annotation
        FROM measurements WHERE arm <> 'R'"""),
    "mapped_reference": (("reference", "cohorts"), "SELECT * FROM reference JOIN cohorts USING (tissue_site)"),
    "mutations": ((), f"""
        SELECT CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_COHORTS)} END AS project_id,
               'C' || user_id AS case_id, 'S' || user_id AS sample_id,
               'BRAND#' || (k % 25 + 1) || '_' || {_list(PART_TYPES)}[k % 6 + 1] AS gene_symbol,
               {_list(VARIANT_CLASSES)}[k % 10 + 1] AS variant_classification,
               CASE WHEN k % 11 = 0 THEN 'Unknown' ELSE 'GRCh38' END AS reference_assembly,
               'chr' || (k % 5) AS chromosome, k + event_id % 3 * 1000 AS start_position, 'A' AS reference_allele,
               CASE WHEN k % 2 = 0 THEN 'T' ELSE 'G' END AS tumor_seq_allele,
               CASE WHEN k % 4 = 0 THEN ' ' ELSE ' ENST' || (k % 4) END AS transcript_id,
               {_list(VARIANT_CLASSES)}[k % 3 + 1] AS vep_consequence,
               CASE k % 3 WHEN 0 THEN ' high' WHEN 1 THEN 'Low ' END AS vep_impact,
               CASE WHEN k % 3 > 0 THEN 'c.1A>G' END AS hgvsc, CASE WHEN k % 4 > 0 THEN 'p.K1N' ELSE ' ' END AS hgvsp,
               CASE WHEN k % 5 = 0 THEN 'x' END AS all_effects,
               CASE WHEN k % 9 = 0 THEN 'placeholder' ELSE 'public/maf' END AS data_origin
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""),
    "profile": (("mutations",), """
        SELECT DISTINCT project_id, sample_id FROM mutations
        UNION ALL SELECT DISTINCT 'NO-EVENT', sample_id FROM mutations"""),
    "gene_sets": ((), """
        SELECT DISTINCT 'SET_' || p_size AS pathway_id, 'Set ' || p_size AS pathway_name, 'Reactome' AS pathway_source,
               upper(p_brand || '_' || p_type) AS gene_symbol FROM part"""),
}


def sql(body: str, *names: str) -> str:
    """SQL text of a query: the CTEs it needs (with their own needs first), then its body."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for parent in SQL_VIEWS[name][0]:
            need(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1]})" for n in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body


# ---------------------------------------------------------------- SQL helpers

def sql_erfc(x: str) -> str:
    """The error-function expression of ``functions.expr.erfc`` as SQL text."""
    from contrastry.functions import expr as e

    def rational(y: str, num, den) -> str:
        top, bottom = f"({num[-1]!r}::DOUBLE * {y})", y
        for a, b in zip(num[:-2], den[:-1]):
            top, bottom = f"(({top} + {a!r}::DOUBLE) * {y})", f"(({bottom} + {b!r}::DOUBLE) * {y})"
        return f"(({top} + {num[-2]!r}::DOUBLE) / ({bottom} + {den[-1]!r}::DOUBLE))"

    sq, inv = f"({x} * {x})", f"(1.0::DOUBLE / ({x} * {x}))"
    return (
        f"CASE WHEN {x} <= 0.46875 THEN 1 - {x} * {rational(sq, e.ERF_A, e.ERF_B)} "
        f"WHEN {x} <= 4 THEN exp(-{sq}) * {rational(x, e.ERF_C, e.ERF_D)} "
        f"ELSE exp(-{sq}) * ((1 / sqrt(pi())) - {inv} * {rational(inv, e.ERF_P, e.ERF_Q)}) / {x} END"
    )


def sql_midrank(value: str, partition: str, descending: bool = False) -> str:
    way = " DESC" if descending else ""
    return (
        f"(rank() OVER (PARTITION BY {partition} ORDER BY {value}{way}) + "
        f"(count(*) OVER (PARTITION BY {partition}, {value}) - 1) / 2.0::DOUBLE)"
    )


def sql_bh(source: str, family: str, p: str, out: str) -> str:
    """Rows of ``source`` plus Benjamini-Hochberg q-values."""
    return (
        f"SELECT * EXCLUDE (_raw), least(1, min(_raw) OVER (PARTITION BY {family} ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) AS {out} "
        f"FROM (SELECT *, {p} * count(*) OVER (PARTITION BY {family}) / count(*) OVER (PARTITION BY {family} ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS _raw "
        f"FROM {source})"
    )


def rounds(names: str, view: str, digits: int = 6) -> str:
    """Every row of a view with the named doubles rounded."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in names.split())}) FROM {view}"
