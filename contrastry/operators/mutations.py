"""Variant classes and mutation marts with an explicit profiled denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastry.functions.expr import blank, present, ratio

# Variant classes of the mutation annotation format.
PROTEIN_ALTERING = (
    "DE_NOVO_START_INFRAME", "DE_NOVO_START_OUTOFFRAME", "FRAME_SHIFT_DEL", "FRAME_SHIFT_INS", "IN_FRAME_DEL", "IN_FRAME_INS",
    "MISSENSE_MUTATION", "NONSENSE_MUTATION", "NONSTOP_MUTATION", "SPLICE_SITE", "START_CODON_DEL", "START_CODON_INS",
    "START_CODON_SNP", "STOP_CODON_DEL", "STOP_CODON_INS", "TRANSLATION_START_SITE",
)
SYNONYMOUS = ("SILENT",)
NON_CODING = (
    "3'FLANK", "3'UTR", "5'FLANK", "5'UTR", "IGR", "INTRON", "LINCRNA", "RNA", "SPLICE_REGION", "TARGETED_REGION",
)
LOSS_OF_FUNCTION = (
    "FRAME_SHIFT_DEL", "FRAME_SHIFT_INS", "NONSENSE_MUTATION", "NONSTOP_MUTATION", "SPLICE_SITE", "TRANSLATION_START_SITE",
)
MISSENSE = ("MISSENSE_MUTATION",)
INFRAME = (
    "DE_NOVO_START_INFRAME", "IN_FRAME_DEL", "IN_FRAME_INS", "START_CODON_DEL", "START_CODON_INS", "STOP_CODON_DEL", "STOP_CODON_INS",
)

GENE = ["project_id", "gene_symbol"]


def normalized_class(c: Column) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("")))), F.lit(" "), F.lit("_"))


def consequence_group(c: Column) -> Column:
    n = normalized_class(c)
    return (
        F.when(n.isin(*PROTEIN_ALTERING), "protein_altering")
        .when(n.isin(*SYNONYMOUS), "synonymous")
        .when(n.isin(*NON_CODING), "non_coding_or_regulatory")
        .otherwise("unclassified")
    )


def is_protein_altering(c: Column) -> Column:
    return normalized_class(c).isin(*PROTEIN_ALTERING)


def protein_impact(c: Column) -> Column:
    n = normalized_class(c)
    return (
        F.when(n.isin(*LOSS_OF_FUNCTION), "putative_loss_of_function")
        .when(n.isin(*MISSENSE), "missense")
        .when(n.isin(*INFRAME), "inframe")
        .when(n.isin(*PROTEIN_ALTERING), "other_protein_altering")
        .otherwise("not_protein_altering")
    )


def classify(mutations: DataFrame) -> DataFrame:
    """Consequence group, protein-altering flag and impact group of every event."""
    c = F.col("variant_classification")
    return mutations.withColumns(
        {"consequence_group": consequence_group(c), "is_protein_altering": is_protein_altering(c), "protein_impact_group": protein_impact(c)}
    )


def with_flag(mutations: DataFrame) -> DataFrame:
    """Add the protein-altering flag where a table lacks it (upper-case match only)."""
    if "is_protein_altering" in mutations.columns:
        return mutations
    return mutations.withColumn("is_protein_altering", F.upper(F.col("variant_classification").cast("string")).isin(*PROTEIN_ALTERING))


def _known(mutations: DataFrame) -> DataFrame:
    return mutations.where(F.col("project_id").isNotNull() & F.col("sample_id").isNotNull() & F.col("gene_symbol").isNotNull())


def denominators(profile: DataFrame, out: str = "total_profiled_sample_count") -> DataFrame:
    """Profiled samples per cohort; pass the events themselves when no profile exists."""
    return profile.groupBy("project_id").agg(F.count_distinct("sample_id").alias(out))


def _altering() -> Column:
    return F.coalesce(F.col("is_protein_altering"), F.lit(False))


def _silent() -> Column:
    return F.upper("variant_classification") == "SILENT"


def frequency_by_gene(mutations: DataFrame, profile: DataFrame) -> DataFrame:
    """Share of profiled samples with a protein-altering event, per gene."""
    events = _known(with_flag(mutations))
    altering = F.when(_altering(), F.col("sample_id"))
    counts = events.groupBy(*GENE).agg(
        F.count_distinct(altering).alias("mutated_sample_count"),
        F.count_if(_altering()).alias("protein_altering_event_count"),
        F.count(F.lit(1)).alias("all_somatic_event_count"),
        F.count_if(_silent()).alias("synonymous_event_count"),
    ).where(F.col("protein_altering_event_count") > 0)
    # a gene has at most as many rows here as there are variant classes
    modal = Window.partitionBy(*GENE).orderBy(F.col("events").desc(), F.col("variant_classification"))
    top = (
        events.where(_altering()).groupBy(*GENE, "variant_classification").agg(F.count(F.lit(1)).alias("events"))
        .withColumn("place", F.row_number().over(modal)).where(F.col("place") == 1)
        .select(*GENE, F.col("variant_classification").alias("top_variant_classification"))
    )
    joined = counts.join(top, GENE, "left").join(denominators(profile), "project_id", "left")
    return joined.select(
        "gene_symbol",
        F.col("project_id").alias("cancer_type"),
        "mutated_sample_count",
        F.coalesce("total_profiled_sample_count", F.lit(0)).cast("long").alias("total_profiled_sample_count"),
        ratio(F.col("mutated_sample_count"), F.col("total_profiled_sample_count")).alias("mutation_frequency"),
        F.coalesce("top_variant_classification", F.lit("Unknown")).alias("top_variant_classification"),
        "protein_altering_event_count", "all_somatic_event_count", "synonymous_event_count",
        F.lit("protein_altering_only").alias("mutation_scope"),
    )


def frequency_by_cancer(mutations: DataFrame, profile: DataFrame) -> DataFrame:
    """Event rate and sample frequency per cohort; cohorts without events stay with zeros."""
    events = _known(with_flag(mutations))
    counts = events.groupBy("project_id").agg(
        F.count_distinct(F.when(_altering(), F.col("sample_id"))).alias("mutated_sample_count"),
        F.count_if(_altering()).alias("mutation_event_count"),
        F.count(F.lit(1)).alias("all_somatic_event_count"),
        F.count_if(_silent()).alias("synonymous_event_count"),
    )
    joined = denominators(profile).join(counts, "project_id", "left").fillna(
        0, ["mutated_sample_count", "mutation_event_count", "all_somatic_event_count", "synonymous_event_count"]
    )
    total = F.col("total_profiled_sample_count")
    return joined.select(
        F.col("project_id").alias("cancer_type"), "total_profiled_sample_count", "mutated_sample_count", "mutation_event_count",
        ratio(F.col("mutation_event_count"), total).alias("mutation_event_rate"),
        "all_somatic_event_count", "synonymous_event_count",
        ratio(F.col("mutated_sample_count"), total).alias("mutation_frequency"),
        F.lit("protein_altering_only").alias("mutation_scope"),
    )


LOCUS = ["project_id", "gene_symbol", "reference_assembly", "chromosome", "start_position", "reference_allele", "tumor_seq_allele"]


def functional_evidence(mutations: DataFrame, profile: DataFrame, *, recurrence_threshold: int = 2) -> DataFrame:
    """Samples per impact group and recurrence of exact loci on a known assembly."""
    if recurrence_threshold < 2:
        raise ValueError("recurrence_threshold must be at least 2")
    flagged = with_flag(mutations)
    source = flagged if "reference_assembly" in flagged.columns else flagged.withColumn("reference_assembly", F.lit("Unknown"))
    events = _known(source).where(_altering()).withColumn("impact", protein_impact(F.col("variant_classification")))
    known = F.col("reference_assembly").isNotNull() & (F.col("reference_assembly") != "Unknown")

    # first one row per (gene, sample): several distinct counts at once would multiply the rows
    groups = {
        "putative_loss_of_function": "putative_loss_of_function_sample_count", "missense": "missense_sample_count",
        "inframe": "inframe_sample_count", "other_protein_altering": "other_protein_altering_sample_count",
    }
    per_sample = events.groupBy(*GENE, "sample_id").agg(
        *[F.max(F.col("impact") == g).alias(c) for g, c in groups.items()],
        F.count_if(known).alias("known_assembly_event_count"), F.count_if(~known).alias("unknown_assembly_event_count"),
    )
    counts = per_sample.groupBy(*GENE).agg(
        F.count(F.lit(1)).alias("protein_altering_mutated_sample_count"),
        *[F.count_if(F.col(c)).alias(c) for c in groups.values()],
        *[F.sum(c).alias(c) for c in ("known_assembly_event_count", "unknown_assembly_event_count")],
    )
    placed = events.where(known & (F.col("chromosome") != "Unknown")).select(*LOCUS, "sample_id").distinct()
    loci = placed.groupBy(*LOCUS).agg(F.count(F.lit(1)).alias("locus_samples")).where(F.col("locus_samples") >= recurrence_threshold)
    carriers = placed.join(loci, LOCUS).groupBy(*GENE).agg(F.count_distinct("sample_id").alias("samples_with_recurrent_locus_count"))
    summary = loci.groupBy(*GENE).agg(
        F.count(F.lit(1)).alias("recurrent_locus_count"), F.max("locus_samples").alias("max_locus_sample_count")
    ).join(carriers, GENE, "left")
    filled = ["recurrent_locus_count", "max_locus_sample_count", "samples_with_recurrent_locus_count"]
    joined = counts.join(denominators(profile), "project_id", "left").join(summary, GENE, "left").fillna(0, filled)
    return joined.select(
        "gene_symbol", F.col("project_id").alias("cancer_type"), "total_profiled_sample_count",
        "protein_altering_mutated_sample_count", "putative_loss_of_function_sample_count", "missense_sample_count",
        "inframe_sample_count", "other_protein_altering_sample_count", *filled,
        ratio(F.col("samples_with_recurrent_locus_count"), F.col("total_profiled_sample_count")).alias("recurrent_locus_sample_fraction"),
        "known_assembly_event_count", "unknown_assembly_event_count",
        F.lit(recurrence_threshold).cast("long").alias("recurrence_threshold_samples"),
        F.lit("consequence_and_exact_locus_recurrence").alias("driver_evidence_scope"),
        F.lit("not_assessed").alias("driver_classification"),
    )


def transcript_evidence(mutations: DataFrame, profile: DataFrame) -> DataFrame:
    """Events and samples per reported transcript annotation, without interpretation."""
    def tidy(name: str) -> Column:
        c = F.trim(F.coalesce(present(mutations, name, F.lit(None)).cast("string"), F.lit("Unknown")))
        c = F.upper(c) if name == "vep_impact" else c
        return F.when(c == "", "Unknown").otherwise(c).alias(name)

    annotations = ["transcript_id", "vep_consequence", "vep_impact", "variant_classification"]
    notes = ["hgvsc", "hgvsp", "all_effects"]
    events = _known(mutations).where(~blank(F.col("gene_symbol"))).select(
        *GENE, "sample_id", *[tidy(a) for a in annotations], *[present(mutations, c, F.lit(None).cast("string")) for c in notes]
    )
    counts = events.groupBy(*GENE, *annotations).agg(
        F.count_distinct("sample_id").alias("distinct_sample_count"),
        F.count(F.lit(1)).alias("event_count"),
        *[F.count_if(~blank(F.col(c))).alias(f"{c}_annotation_event_count") for c in notes],
    )
    joined = counts.join(denominators(profile, "profiled_sample_count"), "project_id", "left")
    return joined.select(
        F.col("project_id").alias("cancer_type"), "gene_symbol", *annotations, "profiled_sample_count", "distinct_sample_count", "event_count",
        ratio(F.col("distinct_sample_count"), F.col("profiled_sample_count")).alias("sample_fraction"),
        *[f"{c}_annotation_event_count" for c in notes],
        F.lit("gdc_maf_reported_transcript").alias("annotation_scope"),
        F.lit("source_vep_category_not_driver_classification").alias("impact_interpretation"),
    )
