"""Defaults of the tumour/normal domain; every operator takes them as arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cohort to reference-tissue mapping.
COHORT_TISSUES = (
    ("TCGA-BRCA", "Breast - Mammary Tissue"),
    ("TCGA-BRCA", "Breast"),
    ("TCGA-LUAD", "Lung"),
    ("TCGA-COAD", "Colon - Transverse"),
    ("TCGA-COAD", "Colon - Sigmoid"),
    ("TCGA-COAD", "Colon"),
)


def cohort_map(spark: SparkSession, pairs=COHORT_TISSUES) -> DataFrame:
    """Literal (cancer_type, tissue_site) map. It is a local relation, so Spark knows its size
    and decides by that, like for any other input, whether to broadcast it."""
    if not pairs:
        return spark.createDataFrame([], "cancer_type string, tissue_site string")
    rows = ", ".join("({}, {})".format(*("'" + str(part).replace("\\", "\\\\").replace("'", "\\'") + "'" for part in pair)) for pair in pairs)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS map(cancer_type, tissue_site)")


def contains_tumour(sample_type: Column) -> Column:
    return F.lower(sample_type.cast("string")).contains("tumor")


def is_primary_tumour(sample_type: Column) -> Column:
    return F.lower(sample_type.cast("string")) == "primary tumor"


def is_adjacent_normal(sample_type: Column) -> Column:
    return F.lower(sample_type.cast("string")) == "solid tissue normal"


def is_star_tpm() -> Column:
    """Rows quantified as TPM by the STAR workflow on Ensembl gene ids."""
    return (
        (F.upper(F.col("expression_unit").cast("string")) == "TPM")
        & F.col("gene_id").cast("string").startswith("ENSG")
        & (
            F.lower(F.col("pipeline_workflow").cast("string")).contains("star")
            | F.lower(F.col("data_origin").cast("string")).contains("rna_seq.augmented_star_gene_counts")
        )
    )
