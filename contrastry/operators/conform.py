"""Conformance transforms of the silver layer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastry.functions.ordered import text_rank


def strip_gene_version(c: Column) -> Column:
    """Drop an Ensembl version, keeping a ``_PAR_Y`` suffix."""
    return F.regexp_replace(c, r"\.\d+(?=_PAR_Y$|$)", "")


def donor_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(GTEX-[^-]+)", 1), F.lit(""))


def dimension(metadata: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct projects, patients or samples of the flat metadata."""
    return metadata.select(*columns).distinct()


MANIFEST = (
    "project_id", "case_id", "sample_id", "file_id", "file_name", "data_category", "data_type", "experimental_strategy", "workflow_type", "access", "file_size", "md5sum",
)


def file_manifest(metadata: DataFrame, ingested_at: str | None = None) -> DataFrame:
    """Manifest projection: lenient size, missing columns as NULL, ingest stamp if given."""
    def column(c: str) -> Column:
        if c not in metadata.columns:
            return F.lit(None).cast("string").alias(c)
        return F.col(c).try_cast("bigint").alias(c) if c == "file_size" else F.col(c).cast("string").alias(c)

    out = metadata.select(*[column(c) for c in MANIFEST])
    return out if ingested_at is None else out.withColumn("ingested_at", F.lit(ingested_at))


def latest_snapshot(df: DataFrame, stamp: Column | str = "_metadata.file_modification_time") -> DataFrame:
    """Rows of the most recently written file."""
    c = F.col(stamp) if isinstance(stamp, str) else stamp
    stamped = df.withColumn("_stamp", c)
    return stamped.where(F.col("_stamp") == stamped.agg(F.max("_stamp")).scalar()).drop("_stamp")


def mixed_workflows(expression: DataFrame) -> DataFrame:
    """(project, sample, unit) quantified by more than one workflow; must be empty."""
    return expression.groupBy("project_id", "sample_id", "expression_unit").agg(F.count_distinct("pipeline_workflow").alias("workflows")).where(F.col("workflows") > 1)


def one_file_per_sample(expression: DataFrame) -> DataFrame:
    """Keep the lexicographically first file of each (project, sample, unit)."""
    keys = ["project_id", "sample_id", "expression_unit"]
    first = expression.groupBy(*keys).agg(F.min("data_origin").alias("data_origin"))
    return expression.join(first, [*keys, "data_origin"], "left_semi")


def duplicate_measurements(expression: DataFrame, keys: Sequence[str] = ("project_id", "sample_id", "expression_unit", "gene_id")) -> DataFrame:
    """Keys measured more than once; must be empty."""
    return expression.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def valid_expression(expression: DataFrame) -> DataFrame:
    """Rows with a gene id and a non-negative value."""
    return expression.where((F.trim(F.coalesce("gene_id", F.lit(""))) != "") & (F.col("expression_value").try_cast("double") >= 0))


def valid_mutations(mutations: DataFrame) -> DataFrame:
    return mutations.where(F.col("start_position").try_cast("bigint").isNotNull())


def downloaded_profiles(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("profile_status") == "downloaded").distinct()


def modality(category: Column) -> Column:
    c = F.lower(category)
    return (
        F.when(c.contains("transcriptome profiling"), "expression").when(c.contains("simple nucleotide variation"), "mutations")
        .when(c.contains("clinical"), "clinical").when(c.contains("biospecimen"), "biospecimen").otherwise("other")
    )


def supported_files(manifest: DataFrame) -> DataFrame:
    """Open files with identity whose data type their modality supports, tagged with the modality."""
    m, kind = F.col("modality"), F.lower(F.trim("data_type"))
    supported = F.when(m == "expression", kind == "gene expression quantification").when(m == "mutations", kind == "masked somatic mutation").otherwise(True)
    return manifest.withColumn("modality", modality(F.col("data_category"))).where(
        (F.lower("access") == "open") & (F.col("file_id") != "") & (F.col("file_name") != "") & supported
    )


def capped_selection(manifest: DataFrame, caps: DataFrame) -> DataFrame:
    """Deterministic selection: the first ``cap`` files per (project, bucket), uncapped where no cap is given.

    ``caps`` is (project_id, bucket, cap). Adjacent normals form their own bucket in
    projects that cap ``expression_normal``.
    """
    own = caps.where(F.col("bucket") == "expression_normal").select("project_id").distinct().withColumn("_own", F.lit(True))
    files = supported_files(manifest).join(own, "project_id", "left")
    normal = (F.col("modality") == "expression") & F.col("_own").isNotNull() & (F.lower(F.trim("sample_type")) == "solid tissue normal")
    bucketed = files.withColumn("bucket", F.when(normal, "expression_normal").otherwise(F.col("modality"))).drop("_own")
    ranked = text_rank(bucketed, ["project_id", "bucket"], ["file_id", "file_name"], "_place")
    return ranked.join(caps, ["project_id", "bucket"], "left").where(F.col("cap").isNull() | (F.col("_place") <= F.col("cap"))).drop("_place", "cap")


def paired_selection(manifest: DataFrame) -> DataFrame:
    """Primary-tumour expression files of cases that also have an adjacent normal."""
    files = supported_files(manifest).where(F.col("modality") == "expression")
    kind = F.lower(F.trim("sample_type"))
    cases = files.where(kind == "solid tissue normal").select("project_id", "case_id").distinct()
    return files.where(kind == "primary tumor").join(cases, ["project_id", "case_id"], "left_semi")


def resolve_files(manifest: DataFrame, listing: DataFrame, *, wanted: str = "expression") -> DataFrame:
    """Manifest files of a modality that exist in the listing (file_name, path), one path each."""
    files = supported_files(manifest).where(F.col("modality") == wanted).select("project_id", "case_id", "sample_id", "file_id", "file_name", "file_size", "md5sum").distinct()
    found = listing.groupBy("file_name").agg(F.min("path").alias("data_origin"))
    return files.join(found, "file_name")


def mutation_profile(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Denominator: mutation files present, one row per (project, file, sample)."""
    return resolve_files(manifest, listing, wanted="mutations").groupBy("project_id", "file_id", "sample_id").agg(
        *[F.min(c).alias(c) for c in ("case_id", "file_name", "file_size", "md5sum", "data_origin")]
    ).withColumn("profile_status", F.lit("downloaded"))


def conform_reprocessed(df: DataFrame) -> DataFrame:
    """Required columns checked, optional ones added, text upper-cased, bad values dropped."""
    missing = {"gene_symbol", "expression_value", "source"} - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")

    def optional(c: str, default: str) -> Column:
        return (F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in df.columns else F.lit(default)).alias(c)

    shaped = df.select(
        F.upper(F.col("source").cast("string")).alias("source"), F.upper(F.col("gene_symbol").cast("string")).alias("gene_symbol"),
        F.col("expression_value").try_cast("double").alias("expression_value"), optional("sample_id", ""), optional("project_id", ""), optional("sample_type", ""),
        optional("tissue_site", ""), optional("external_annotation", "unknown"),
    )
    return shaped.where(F.col("expression_value") >= 0)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Cohort parts in one table; columns a part lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
