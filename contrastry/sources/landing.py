"""Landing jobs: raw text, matrices, annotation, gene sets and nested metadata to long tables.

Files of one kind may differ in layout. They are read as lines; a header line is
recognised by its content, the wanted columns are located once per file, and data
lines join their file's positions. All files land in one job and splittable files
stay split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.functions.expr import log2p1
from contrastry.functions.ordered import text_rank
from contrastry.operators.conform import donor_id, strip_gene_version
from contrastry.operators.mutations import consequence_group, is_protein_altering


def read_parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table with its declared schema, or an empty one where nothing was written."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    exists = location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def read_delimited(spark: SparkSession, path: str, *, schema: str | None = None) -> DataFrame:
    """Delimited text as strings: comma for .csv, else tab; ``#`` comments, ragged rows and gzip accepted."""
    sep = "," if ".csv" in path.lower() else "\t"
    reader = spark.read.option("sep", sep).option("header", True).option("comment", "#").option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def resolve_column(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """First alias the table offers, ignoring case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[a.lower()] for a in aliases if a.lower() in have), None)


def lines(spark: SparkSession, path: str, *, folders: bool = False) -> DataFrame:
    """(file_name, file_path, value, _at) of every line under the path; ``_at`` orders the lines of a file.

    With ``folders`` each leaf folder is one logical file of several parts, named by
    its last path element (the value part of ``key=value``).
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    file_path = F.col("_metadata.file_path")
    place = F.struct(F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("_at")
    if not folders:
        return raw.select(F.col("_metadata.file_name").alias("file_name"), file_path.alias("file_path"), "value", place)
    parent = F.regexp_replace(file_path, "/[^/]*$", "")
    return raw.select(F.regexp_extract(parent, "([^/=]+)$", 1).alias("file_name"), parent.alias("file_path"), "value", place)


def layouts(
    raw: DataFrame, markers: Sequence[str], columns: Mapping[str, Sequence[str]], *, sep: str = "\t"
) -> tuple[DataFrame, DataFrame]:
    """Split lines into (per-file layout, data rows).

    The first line of a file that holds one of the ``markers`` as a field is its header;
    later lines with such a field (a gene of that name) are data. The layout has the header
    and, per wanted column, the position of the first alias present.
    """
    if "_at" not in raw.columns:
        raw = raw.withColumn("_at", F.monotonically_increasing_id())
    parsed = raw.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_fields", F.split("value", sep))
    lowered = F.transform("_fields", lambda c: F.lower(F.trim(c)))
    tagged = parsed.withColumn("_header", F.arrays_overlap(lowered, F.array(*[F.lit(m.lower()) for m in markers])))

    def position(aliases: Sequence[str]) -> Column:
        return F.coalesce(*[F.nullif(F.array_position("header", a.lower()), F.lit(0).cast("long")) for a in aliases])

    header = tagged.where("_header").groupBy("file_name", "file_path").agg(F.min_by(lowered, "_at").alias("header"), F.min("_at").alias("_header_at"))
    layout = header.select("file_name", "file_path", "header", *[position(a).cast("int").alias(f"at_{c}") for c, a in columns.items()])
    data = tagged.join(header.select("file_path", "_header_at"), "file_path").where(F.col("_at") != F.col("_header_at"))
    return layout, data.select("file_name", "file_path", "_fields")


def at(column: str) -> Column:
    """The field a layout located, NULL when the file lacks it or the row is short."""
    return F.try_element_at("_fields", F.col(f"at_{column}"))


# ---------------------------------------------------------------- expression

# Accepted column names, in order of preference.
SAMPLE_NAMES = ("sample_id", "sample", "sampleid")
GENE_NAMES = ("gene_id", "gene", "ensembl_gene_id", "mirna_id")
SYMBOL_NAMES = ("gene_symbol", "symbol", "hgnc_symbol", "gene_name")
VALUE_NAMES = (
    "expression_value", "tpm_unstranded", "tpm", "fpkm_unstranded", "fpkm_uq_unstranded", "fpkm", "reads_per_million_mirna_mapped",
    "read_count", "count", "unstranded", "value",
)
STAR_VALUES = ("tpm_unstranded", "fpkm_unstranded", "fpkm_uq_unstranded", "unstranded", "read_count", "count")
HTSEQ_VALUES = ("count", "read_count", "unstranded")
FPKM_VALUES = ("fpkm_uq_unstranded", "fpkm_unstranded", "fpkm")
#: Columns of a wide line that become rows together.
TILE = 1_000
SUMMARY_ROWS = ("n_unmapped", "n_multimapping", "n_nofeature", "n_ambiguous")


def _first(names: Sequence[str]) -> Column:
    """First of the names the header has."""
    return F.try_element_at(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains("header", n)), F.lit(1))


def land_expression_files(raw: DataFrame, manifest: DataFrame, *, sep: str = "\t") -> DataFrame:
    """Single-sample quantification files of any accepted layout, with manifest metadata by file name.

    The value column and unit follow the workflow: TPM before FPKM before counts.
    """
    layout, data = layouts(raw, GENE_NAMES, {"sample": SAMPLE_NAMES, "gene": GENE_NAMES, "symbol": SYMBOL_NAMES}, sep=sep)
    meta = manifest.groupBy("file_name").agg(*[F.min(c).alias(f"m_{c}") for c in ("project_id", "case_id", "sample_id", "sample_type", "workflow_type")])
    w = F.lower(F.trim(F.coalesce("m_workflow_type", F.lit(""))))
    star = w.contains("star - counts") | w.contains("star_counts") | w.contains("augmented_star_gene_counts")
    htseq = w.contains("htseq - counts") | w.contains("htseq_counts")
    forced_count = htseq & _first(HTSEQ_VALUES).isNotNull() & ~(star & _first(STAR_VALUES).isNotNull())
    chosen = F.coalesce(
        F.when(star, _first(STAR_VALUES)), F.when(htseq, _first(HTSEQ_VALUES)), F.when(w.contains("fpkm"), _first(FPKM_VALUES)), _first(VALUE_NAMES)
    )
    forced_fpkm = w.contains("fpkm") & _first(FPKM_VALUES).isNotNull() & ~star & ~htseq
    c = F.col("value_column")
    unit = (
        F.when(F.col("_count"), "COUNT").when(F.col("_fpkm"), "FPKM")
        .when((c == "tpm") | c.startswith("tpm_"), "TPM").when((c == "fpkm") | c.startswith("fpkm_"), "FPKM")
        .when((c == "count") | c.endswith("_count") | (c == "unstranded"), "COUNT").when(w.contains("count"), "COUNT").otherwise("TPM")
    )
    files = (
        layout.join(meta, "file_name", "left").withColumns({"value_column": chosen, "_count": forced_count, "_fpkm": forced_fpkm})
        .where(c.isNotNull() & F.col("at_gene").isNotNull())
        .withColumn("at_value", F.array_position("header", c).cast("int")).withColumn("expression_unit", unit)
        .drop("header", "file_name")
    )
    unknown = F.lit("Unknown")
    rows = data.join(files, "file_path").select(
        F.coalesce("m_project_id", unknown).alias("project_id"), F.coalesce("m_case_id", unknown).alias("case_id"),
        F.coalesce(at("sample"), "m_sample_id", unknown).alias("sample_id"), F.coalesce("m_sample_type", unknown).alias("sample_type"),
        at("gene").alias("_raw"), F.coalesce(at("symbol"), at("gene"), unknown).alias("gene_symbol"),
        F.coalesce(at("value").try_cast("double"), F.lit(0.0)).alias("expression_value"), "expression_unit",
        F.coalesce("m_workflow_type", unknown).alias("pipeline_workflow"), F.col("file_path").alias("data_origin"),
    ).where((F.col("_raw") != "") & ~F.col("_raw").startswith("__") & ~F.lower("_raw").isin(*SUMMARY_ROWS))
    return rows.select(
        "project_id", "case_id", "sample_id", "sample_type", strip_gene_version(F.col("_raw")).alias("gene_id"), "gene_symbol",
        "expression_value", "expression_unit", log2p1(F.col("expression_value")).alias("log2_expression"), "pipeline_workflow", "data_origin",
    )


def land_reference_files(raw: DataFrame, *, version: str = "v8", sep: str = ",") -> DataFrame:
    """Reference-tissue measurements in long delimited files."""
    names = {
        "sample": ("gtex_sample_id", "sample_id", "sample"), "tissue": ("tissue_site", "tissue"), "detail": ("tissue_detail", "tissue_detail_site", "tissue"),
        "gene": ("gene_id", "gene", "ensembl_gene_id"), "symbol": ("gene_symbol", "symbol", "hgnc_symbol"), "value": ("expression_value", "tpm", "value"),
        "unit": ("expression_unit", "unit"), "version": ("source_version", "version"),
    }
    layout, data = layouts(raw, ("gene_id", "ensembl_gene_id"), names, sep=sep)
    usable = layout.where(F.col("at_sample").isNotNull() & F.col("at_tissue").isNotNull() & F.col("at_value").isNotNull()).drop("header", "file_name")
    rows = data.join(usable, "file_path").withColumn("expression_value", F.coalesce(at("value").try_cast("double"), F.lit(0.0)))
    return rows.select(
        at("sample").alias("gtex_sample_id"), F.coalesce(donor_id(at("sample")), F.lit("Unknown")).alias("donor_id"), at("tissue").alias("tissue_site"),
        F.coalesce(at("detail"), at("tissue")).alias("tissue_detail"), strip_gene_version(at("gene")).alias("gene_id"),
        F.coalesce(at("symbol"), F.lit("Unknown")).alias("gene_symbol"), "expression_value", F.coalesce(at("unit"), F.lit("TPM")).alias("expression_unit"),
        log2p1(F.col("expression_value")).alias("log2_expression"), F.coalesce(at("version"), F.lit(version)).alias("source_version"), F.col("file_path").alias("data_origin"),
    )


def malformed_matrices(raw: DataFrame) -> DataFrame:
    """Matrix files without the expected version line or header; must be empty."""
    seen = raw.groupBy("file_path").agg(
        F.count_if(F.col("value").startswith("#1.3")).alias("versions"), F.count_if(F.lower("value").rlike("^id\\tname\\tdescription\\t")).alias("headers")
    )
    return seen.where((F.col("versions") != 1) | (F.col("headers") != 1))


def land_matrix(raw: DataFrame, tissues: DataFrame, *, cap: int | None = None, version: str = "v8") -> DataFrame:
    """Wide matrices (id, Name, Description, one column per sample) to long rows.

    ``tissues`` is (file_name, tissue_site). ``cap`` keeps the first samples of each file.
    """
    fields = F.split("value", "\t")
    header_line = F.lower("value").rlike("^id\\tname\\tdescription\\t")
    matrix = raw.where(F.instr("value", "\t") > 0)
    names = matrix.where(header_line).select("file_path", F.posexplode(_behind(fields, 3)).alias("_pos", "gtex_sample_id"))
    names = names if cap is None else names.where(F.col("_pos") < cap)
    # dimension lines ("genes<TAB>samples") have no name column
    data = matrix.where(~header_line & (F.size(fields) >= 4)).select("file_name", "file_path", fields[1].alias("_raw"), fields[2].alias("gene_symbol"), _behind(fields, 3).alias("_cells"))
    value = F.coalesce(F.col("_cell").try_cast("double"), F.lit(0.0))
    return selected_cells(data, names, ["gtex_sample_id"]).join(tissues, "file_name").select(
        "gtex_sample_id", donor_id(F.col("gtex_sample_id")).alias("donor_id"), "tissue_site", F.col("tissue_site").alias("tissue_detail"),
        strip_gene_version(F.col("_raw")).alias("gene_id"), "gene_symbol", value.alias("expression_value"), F.lit("TPM").alias("expression_unit"),
        log2p1(value).alias("log2_expression"), F.lit(version).alias("source_version"), F.col("file_path").alias("data_origin"),
    )


def _behind(fields: Column, first: int) -> Column:
    return F.slice(fields, first + 1, F.greatest(F.size(fields) - first, F.lit(0)))


def selected_cells(data: DataFrame, columns: DataFrame, attributes: Sequence[str], *, tile: int = TILE) -> DataFrame:
    """Wide rows (file_path, …, _cells) to one row (…, attributes, _cell) for each selected column.

    ``columns`` is (file_path, _pos, attributes…) with the columns to keep. They are gathered into
    tiles of ``tile`` columns with their positions, and a line is cut at the same places, so it meets
    each tile with the cells of that tile alone, and only the cells at its positions ever become
    rows. A line that is too short lacks its last cells.
    """
    tiles = columns.withColumn("_tile", F.floor(F.col("_pos") / tile)).groupBy("file_path", "_tile").agg(
        F.collect_list(F.struct("_pos", *attributes)).alias("_kept"))  # at most ``tile`` columns
    tiled = cell_tiles(data, tile=tile).join(tiles, ["file_path", "_tile"])
    inside = F.col("_tile") * tile
    found = F.filter(F.transform("_kept", lambda c: F.struct(*[c[a].alias(a) for a in attributes], F.get("_cells", (c["_pos"] - inside).cast("int")).alias("_cell"))), lambda c: c["_cell"].isNotNull())
    others = [c for c in data.columns if c != "_cells"]
    return tiled.select(*others, F.inline(found))


def cell_tiles(data: DataFrame, *, tile: int = TILE) -> DataFrame:
    """Wide rows (…, _cells) to one row (…, _tile, _cells) for every ``tile`` cells of a line."""

    def cut(cells: Column) -> Column:
        last = F.floor(F.greatest(F.size(cells) - 1, F.lit(0)) / tile)
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda t: F.struct(t.alias("_tile"), F.slice(cells, (t * tile + 1).cast("int"), tile).alias("_cells")))

    # the cells are bound once: inside the inner function their expression would split the line again for each tile
    pieces = F.flatten(F.transform(F.array("_cells"), cut))
    return data.select(*[c for c in data.columns if c != "_cells"], F.inline(pieces))


def tissue_mismatches(landed: DataFrame, attributes: DataFrame) -> DataFrame:
    """Samples whose declared tissue (SAMPID, SMTSD) differs from their file's; must be empty."""
    declared = attributes.select(F.col("SAMPID").alias("gtex_sample_id"), F.col("SMTSD").alias("declared"))
    return landed.select("gtex_sample_id", "tissue_site").distinct().join(declared, "gtex_sample_id", "left").where(
        ~F.coalesce(F.col("declared") == F.col("tissue_site"), F.lit(False))
    )


def matrix_report(landed: DataFrame) -> DataFrame:
    return landed.groupBy("tissue_site").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("gtex_sample_id").alias("sample_count"), F.count_distinct("gene_id").alias("gene_count")
    )


# ---------------------------------------------------------------- mutations

# Accepted column names of mutation files.
MUTATION_COLUMNS = {
    "sample": ("sample_id", "tumor_sample_barcode", "tumor_sample"), "gene": ("gene_id", "ensembl_gene_id"), "symbol": ("hugo_symbol", "gene_symbol", "symbol"),
    "class": ("variant_classification",), "type": ("variant_type",), "assembly": ("ncbi_build", "reference_assembly", "genome_build"),
    "chromosome": ("chromosome", "chr"), "start": ("start_position", "start_pos", "position"), "end": ("end_position", "end_pos", "position"),
    "ref": ("reference_allele", "ref_allele"), "alt": ("tumor_seq_allele2", "tumor_seq_allele", "tumor_allele"), "case": ("case_id",),
    "transcript_id": ("transcript_id",), "hgvsc": ("hgvsc",), "hgvsp": ("hgvsp",), "hgvsp_short": ("hgvsp_short",), "exon_number": ("exon_number",),
    "vep_impact": ("impact",), "vep_consequence": ("consequence",), "vep_one_consequence": ("one_consequence",), "all_effects": ("all_effects",),
}
ANNOTATIONS = ("transcript_id", "hgvsc", "hgvsp", "hgvsp_short", "exon_number", "vep_impact", "vep_consequence", "vep_one_consequence", "all_effects")


def land_mutations(raw: DataFrame, *, sep: str = "\t") -> DataFrame:
    """Mutation rows of any accepted layout; positions are lenient integers, blank annotations NULL."""
    layout, data = layouts(raw, ("hugo_symbol", "gene_symbol", "variant_classification"), MUTATION_COLUMNS, sep=sep)
    usable = layout.where(F.col("at_sample").isNotNull() & F.col("at_symbol").isNotNull() & F.col("at_start").isNotNull()).drop("header", "file_name")
    unknown = F.lit("Unknown")

    def text(name: str) -> Column:
        return F.coalesce(at(name), unknown)

    start = at("start").try_cast("bigint")
    return data.join(usable, "file_path").select(
        at("sample").alias("sample_id"), at("sample").alias("source_sample_id"), at("case").alias("case_id_file"),
        F.coalesce(strip_gene_version(at("gene")), F.lit("")).alias("gene_id"), text("symbol").alias("gene_symbol"),
        text("class").alias("variant_classification"), consequence_group(at("class")).alias("consequence_group"), is_protein_altering(at("class")).alias("is_protein_altering"),
        text("type").alias("variant_type"), F.coalesce(F.nullif(F.trim(at("assembly")), F.lit("")), unknown).alias("reference_assembly"),
        text("chromosome").alias("chromosome"), start.alias("start_position"), F.coalesce(at("end").try_cast("bigint"), F.when(F.col("at_end").isNull(), start)).alias("end_position"),
        text("ref").alias("reference_allele"), text("alt").alias("tumor_seq_allele"), *[F.nullif(F.trim(at(a)), F.lit("")).alias(a) for a in ANNOTATIONS],
        "file_name", F.col("file_path").alias("data_origin"),
    )


def canonical_samples(landed: DataFrame, metadata: DataFrame, *, project_from_path: Column | None = None) -> DataFrame:
    """Attach project and case, and replace the file's sample barcode by the registered id.

    The replacement happens only where file and case identify exactly one sample on
    both sides. ``metadata`` is (project_id, case_id, sample_id, file_name, ...).
    """
    by_sample = metadata.groupBy("sample_id").agg(F.min("project_id").alias("_ps"), F.min("case_id").alias("_cs"))
    by_case = metadata.groupBy(F.col("case_id").alias("case_id_file")).agg(F.min("project_id").alias("_pc"))
    eligible = metadata
    if {"data_category", "data_type"} <= set(metadata.columns):
        eligible = eligible.where(F.lower("data_category").contains("simple nucleotide variation") & F.lower("data_type").contains("somatic mutation"))
    if "access" in metadata.columns:
        eligible = eligible.where(F.lower("access") == "open")
    single = eligible.groupBy("file_name", F.col("case_id").alias("case_id_file")).agg(
        F.min("sample_id").alias("_canonical"), F.count_distinct("sample_id").alias("_n")).where(F.col("_n") == 1).drop("_n")
    used = landed.groupBy("file_name", "case_id_file").agg(F.count_distinct("source_sample_id").alias("_n")).where(F.col("_n") == 1).drop("_n")
    unique = single.join(used, ["file_name", "case_id_file"])
    path = F.lit("Unknown") if project_from_path is None else project_from_path
    joined = landed.join(by_sample, "sample_id", "left").join(by_case, "case_id_file", "left").join(unique, ["file_name", "case_id_file"], "left")
    others = [c for c in landed.columns if c not in ("sample_id", "case_id_file", "file_name")]
    return joined.select(
        F.coalesce("_ps", "_pc", path, F.lit("Unknown")).alias("project_id"), F.coalesce("_cs", "case_id_file", F.lit("Unknown")).alias("case_id"),
        F.coalesce("_canonical", "sample_id", F.lit("Unknown")).alias("sample_id"), *others,
    )


# ---------------------------------------------------------------- annotation, counts, gene sets, metadata

def land_annotation(raw: DataFrame) -> DataFrame:
    """Gene id and upper-case symbol from GTF ``gene`` features, one row per id."""
    fields = F.split("value", "\t")
    genes = raw.where(~F.col("value").startswith("#")).where((F.size(fields) >= 9) & (fields[2] == "gene")).select(
        F.regexp_extract(fields[8], r'gene_id "([^"]+)"', 1).alias("raw_gene_id"), F.upper(F.regexp_extract(fields[8], r'gene_name "([^"]+)"', 1)).alias("gene_symbol")
    )
    return genes.where((F.col("raw_gene_id") != "") & (F.col("gene_symbol") != "")).groupBy("raw_gene_id").agg(F.min("gene_symbol").alias("gene_symbol"))


def select_count_samples(metadata: DataFrame, qc: DataFrame, *, cap: int | None = None, group: Sequence[str] = ("cohort",)) -> DataFrame:
    """Samples with positive coverage, ordered by id, the first ``cap`` per cohort."""
    good = metadata.join(qc.groupBy("sample_id").agg(F.min("auc").alias("auc")), "sample_id").where(F.col("auc") > 0).dropDuplicates(["sample_id"])
    if cap is None:
        return good
    return text_rank(good, list(group), ["sample_id"], "_place").where(F.col("_place") <= cap).drop("_place")


TARGET_LIBRARY = 4e7


def land_counts(raw: DataFrame, selected: DataFrame, annotation: DataFrame, *, external_annotation: str = "G029") -> DataFrame:
    """Wide coverage counts to long values scaled to a common library size.

    ``selected`` is (sample_id, auc, source, project_id, sample_type, tissue_site).
    """
    fields = F.split("value", "\t")
    body = raw.where(~F.col("value").startswith("#"))
    header_line = F.col("value").startswith("gene_id\t")
    attributes = ["sample_id", "source", "project_id", "sample_type", "tissue_site", "auc"]
    columns = body.where(header_line).select("file_path", F.posexplode(_behind(fields, 1)).alias("_pos", "sample_id")).join(selected, "sample_id").select("file_path", "_pos", *attributes)
    data = body.where(~header_line).select("file_path", fields[0].alias("raw_gene_id"), _behind(fields, 1).alias("_cells")).join(annotation, "raw_gene_id")
    value = F.col("_cell").try_cast("double") * (F.lit(TARGET_LIBRARY) / F.col("auc"))
    return selected_cells(data, columns, attributes).select(
        "source", "project_id", "sample_id", "sample_type", "tissue_site", strip_gene_version(F.col("raw_gene_id")).alias("gene_id"), "gene_symbol",
        value.alias("expression_value"), F.lit("AUC-scaled coverage count (40M target)").alias("expression_unit"), F.lit(external_annotation).alias("external_annotation"),
    ).where(F.col("expression_value") >= 0)


def pathway_id(name: Column, description: Column) -> Column:
    """Stable identifier if the name or description carries one, else a slug of the name; beyond 96 characters a hash of the whole name ends it."""
    stable = F.coalesce(*[F.nullif(F.regexp_extract(c, r"(R-HSA-\d+)", 1), F.lit("")) for c in (name, description)])
    whole = F.upper(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", ""))
    slug = F.when(F.length(whole) <= 96, whole).otherwise(F.concat(F.substring(whole, 1, 96), F.lit("_"), F.upper(F.substring(F.sha2(name, 256), 1, 12))))
    return F.coalesce(stable, F.nullif(slug, F.lit("")), F.lit("UNKNOWN_PATHWAY"))


def gene_set_lines(raw: DataFrame, *, source: str = "Reactome") -> DataFrame:
    """One row per set with its sorted distinct members."""
    parts = F.transform(F.split("value", "\t"), lambda c: F.trim(c))
    genes = F.array_sort(F.array_distinct(F.transform(F.filter(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda g: g != ""), lambda g: F.upper(g))))
    return raw.where((F.size(parts) >= 3) & (parts[0] != "")).select(
        pathway_id(parts[0], parts[1]).alias("pathway_id"), parts[0].alias("pathway_name"), F.lit(source).alias("pathway_source"), genes.alias("genes")
    ).where(F.size("genes") > 0)


def land_gene_sets(raw: DataFrame, *, source: str = "Reactome") -> DataFrame:
    """Membership rows (pathway_id, pathway_name, pathway_source, gene_symbol)."""
    return gene_set_lines(raw, source=source).select("pathway_id", "pathway_name", "pathway_source", F.explode("genes").alias("gene_symbol"))


def gene_set_structure(raw: DataFrame) -> DataFrame:
    """Line, short-line, set and gene counts, and whether the file may be accepted."""
    parts = F.split("value", "\t")
    filled = F.trim("value") != ""
    return raw.agg(
        F.count_if(filled).alias("set_lines"), F.count_if(filled & (F.size(parts) < 3)).alias("short_lines"),
        F.coalesce(F.sum(F.when(filled & (F.size(parts) >= 3), F.size(parts) - 2)), F.lit(0)).cast("long").alias("member_entries"),
    ).withColumn("accepted", (F.col("set_lines") > 0) & (F.col("short_lines") == 0))


HIT_SCHEMA = (
    "id string, file_id string, file_name string, data_category string, data_type string, experimental_strategy string, access string, file_size bigint, md5sum string, "
    "slice int, analysis struct<workflow_type:string>, cases array<struct<case_id:string, submitter_id:string, "
    "project:struct<project_id:string, primary_site:string, disease_type:string>, samples:array<struct<sample_id:string, submitter_id:string, sample_type:string>>>>"
)


def land_file_metadata(hits: DataFrame, *, default_project: str = "Unknown") -> DataFrame:
    """Nested file hits to flat records: first case, first sample, defaults where absent."""
    case = F.try_element_at("cases", F.lit(1))
    sample = F.try_element_at(case["samples"], F.lit(1))

    def text(c: Column, default: str = "Unknown") -> Column:
        return F.coalesce(c.cast("string"), F.lit(default))

    return hits.select(
        text(case["project"]["project_id"], default_project).alias("project_id"), text(case["case_id"]).alias("case_id"), text(case["submitter_id"]).alias("submitter_id"),
        F.coalesce(F.nullif(sample["sample_id"], F.lit("")), sample["submitter_id"], F.lit("Unknown")).alias("sample_id"), text(sample["sample_type"]).alias("sample_type"),
        text(case["project"]["primary_site"]).alias("primary_site"), text(case["project"]["disease_type"]).alias("disease_type"),
        F.coalesce(F.nullif(F.col("file_id"), F.lit("")), F.col("id"), F.lit("")).alias("file_id"), text(F.col("file_name")).alias("file_name"), text(F.col("data_category")).alias("data_category"),
        text(F.col("data_type")).alias("data_type"), text(F.col("experimental_strategy")).alias("experimental_strategy"), text(F.col("analysis.workflow_type")).alias("workflow_type"),
        text(F.col("access"), "open").alias("access"), F.coalesce("file_size", F.lit(0)).cast("bigint").alias("file_size"), text(F.col("md5sum"), "").alias("md5sum"), "slice",
    )


def first_slice_wins(records: DataFrame) -> DataFrame:
    """One record per file: the one of the lowest slice (an aggregate, no per-file sort)."""
    columns = [c for c in records.columns if c not in ("file_id", "slice")]
    best = records.groupBy("file_id").agg(F.min(F.struct("slice", *columns)).alias("r"))
    return best.select("file_id", "r.*").select(*records.columns)


def slice_audit(records: DataFrame) -> DataFrame:
    """Records and duplicates (files already delivered by an earlier slice) per slice."""
    first = records.groupBy("file_id").agg(F.min("slice").alias("_first"))
    per = records.groupBy("file_id", "slice").agg(F.count(F.lit(1)).alias("n")).join(first, "file_id")
    return per.groupBy("slice").agg(
        F.sum("n").alias("record_count"), F.sum(F.when(F.col("slice") == F.col("_first"), F.col("n") - 1).otherwise(F.col("n"))).alias("duplicate_count")
    )
