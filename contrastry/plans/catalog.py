"""All registered queries, gathered from the families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.plans import files, gold_contrasts, gold_evidence, gold_statistics, readouts, reads, silver, studies

FAMILIES = (gold_contrasts, gold_statistics, gold_evidence, studies, reads, readouts, silver, files)

QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: text for family in FAMILIES for name, text in family.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str, cohort: str = "BUILDING", limit: int = 50) -> DataFrame:
    marts = gold_contrasts.contrast(spark, sf_dir)
    return marts.where(F.col("cancer_type") == cohort).orderBy(F.col("log2_fold_change").desc(), "gene_symbol").limit(limit)
