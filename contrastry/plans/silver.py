"""Landing jobs, conformance and sinks on files written from the tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrastry.functions.expr import rounded
from contrastry.operators import conform as c_ops
from contrastry.operators.resampling import require_none
from contrastry.plans import gold_evidence as ge
from contrastry.plans import gold_statistics as gs
from contrastry.plans import studies as st
from contrastry.plans import views as v
from contrastry.session import scratch_path
from contrastry.sources import landing as land
from contrastry.sources import sinks


def _write_lines(df, label):
    """(name, value) rows to one folder per name; parts stay spread over tasks."""
    path = scratch_path(df.sparkSession, label)
    df.select("name", "value").write.partitionBy("name").text(path)
    return path


def _with_headers(body, heads):
    """Body lines plus the header lines of every name that occurs."""
    names = body.select("name").distinct()  # once for all header lines
    return body.unionByName(names.select("name", F.explode(F.array(*heads)).alias("value")))


# ---------------------------------------------------------------- expression files

def _part_lines(s, d):
    lines, part = v.table(s, d, "lineitem"), v.table(s, d, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("B"), F.regexp_extract("p_brand", r"(\d+)", 1)).alias("name"), "l_partkey", "p_size", "p_name", "l_extendedprice", "l_quantity", "l_linenumber")


def _star_file():
    """Brands 1-9 come as augmented counts, the others as plain counts."""
    return F.length("name") == 2


def expression_files(s, d):
    rows = _part_lines(s, d)
    gene = F.concat(F.lit("ENSG"), "l_partkey", F.lit("."), "p_size")
    star = F.concat_ws("\t", gene, "p_name", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"))
    plain = F.concat_ws("\t", F.when(F.col("l_linenumber") == 7, "__no_feature").otherwise(gene), F.col("l_quantity").cast("string"))
    body = rows.select("name", F.when(_star_file(), star).otherwise(plain).alias("value"))
    head = F.when(_star_file(), "gene_id\tgene_name\tunstranded\ttpm_unstranded").otherwise("gene_id\tcount")
    path = _write_lines(_with_headers(body, [F.lit("# gene-model: v36"), head]), "expression")
    manifest = rows.select("name").distinct().select(
        F.col("name").alias("file_name"), F.lit("P1").alias("project_id"), F.concat(F.lit("C"), "name").alias("case_id"), F.concat(F.lit("S"), "name").alias("sample_id"),
        F.lit("Primary Tumor").alias("sample_type"), F.when(_star_file(), "STAR - Counts").otherwise("HTSeq - Counts").alias("workflow_type"))
    return land.land_expression_files(land.lines(s, path, folders=True), manifest).drop("data_origin")


_EXPRESSION_SQL = """SELECT 'P1' AS project_id, 'C' || name AS case_id, 'S' || name AS sample_id, 'Primary Tumor' AS sample_type, 'ENSG' || l_partkey AS gene_id,
    CASE WHEN star THEN p_name ELSE 'ENSG' || l_partkey || '.' || p_size END AS gene_symbol, CASE WHEN star THEN l_extendedprice ELSE l_quantity END AS expression_value,
    CASE WHEN star THEN 'TPM' ELSE 'COUNT' END AS expression_unit, round(log2(CASE WHEN star THEN l_extendedprice ELSE l_quantity END + 1), 6) AS log2_expression,
    CASE WHEN star THEN 'STAR - Counts' ELSE 'HTSeq - Counts' END AS pipeline_workflow
    FROM (SELECT *, 'B' || regexp_extract(p_brand, '(\\d+)', 1) AS name, length(regexp_extract(p_brand, '(\\d+)', 1)) = 1 AS star FROM lineitem JOIN part ON l_partkey = p_partkey)
    WHERE star OR l_linenumber <> 7"""


def reference_files(s, d):
    """Reference measurements as long comma-separated files, one for each tissue."""
    rows = v.reference(s, d).withColumn("name", F.regexp_replace("tissue_site", "[^A-Za-z0-9]+", "_"))
    body = rows.select("name", F.concat_ws(",", F.when(F.col("gene_symbol").contains("#1"), F.concat(F.lit("GTEX-"), F.regexp_replace("donor_id", "[^A-Za-z0-9]", ""), F.lit("-"), "gtex_sample_id"))
                                           .otherwise(F.col("gtex_sample_id")), "tissue_site", F.concat("gene_id", F.lit(".7")), "gene_symbol", F.col("expression_value").cast("string")).alias("value"))
    path = _write_lines(_with_headers(body, [F.lit("sample,tissue,gene_id,symbol,tpm")]), "reference")
    landed = land.land_reference_files(land.lines(s, path, folders=True))
    return rounded(landed.groupBy("tissue_site", "tissue_detail", "gene_id", "gene_symbol", "donor_id", "expression_unit", "source_version").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("gtex_sample_id").alias("samples"), F.max("expression_value").alias("largest"), F.max("log2_expression").alias("largest_log2")))


_REFERENCE_SQL = """SELECT tissue_site, tissue_site AS tissue_detail, gene_id, gene_symbol,
    CASE WHEN gene_symbol LIKE '%#1%' THEN 'GTEX-' || regexp_replace(donor_id, '[^A-Za-z0-9]', '', 'g') ELSE 'Unknown' END AS donor_id, 'TPM' AS expression_unit, 'v8' AS source_version,
    count(*) AS rows, count(DISTINCT gtex_sample_id) AS samples, round(max(expression_value), 6) AS largest, round(max(log2(expression_value + 1)), 6) AS largest_log2 FROM reference GROUP BY ALL"""


# ---------------------------------------------------------------- mutation files

def mutation_files(s, d):
    m = v.table(s, d, "events").select("event_type", "user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    classes = F.array(*[F.lit(x) for x in v.VARIANT_CLASSES])
    fields = F.concat_ws(
        "\t", F.concat(F.lit("G"), F.col("k") % 20), F.concat(F.lit("BAR"), "user_id"), F.concat(F.lit("C"), "user_id"), F.element_at(classes, (F.col("k") % 10 + 1).cast("int")),
        F.lit(" GRCh38 "), F.concat(F.lit("chr"), F.col("k") % 5), F.when(F.col("k") % 13 == 0, "x").otherwise(F.col("k").cast("string")), F.lit("A"), F.lit("T"),
        F.when(F.col("k") % 3 == 0, " ").otherwise("p.K1N"))
    body = m.select(F.col("event_type").alias("name"), fields.alias("value"))
    head = F.lit("Hugo_Symbol\tTumor_Sample_Barcode\tcase_id\tVariant_Classification\tNCBI_Build\tChromosome\tStart_Position\tReference_Allele\tTumor_Seq_Allele2\tHGVSp")
    path = _write_lines(_with_headers(body, [F.lit("#version 2.4"), head]), "mutations")
    users = m.select("event_type", "user_id").distinct()
    # every case has one registered sample; every third case a second one
    metadata = users.select(
        F.lit("P2").alias("project_id"), F.concat(F.lit("C"), "user_id").alias("case_id"), F.explode(F.when(F.col("user_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("x"),
        F.col("event_type").alias("file_name"), "user_id").select("project_id", "case_id", F.concat(F.lit("U"), "user_id", "x").alias("sample_id"), "file_name")
    landed = land.land_mutations(land.lines(s, path, folders=True))
    return land.canonical_samples(landed, metadata).select(
        "project_id", "case_id", "sample_id", "source_sample_id", "gene_symbol", "variant_classification", "consequence_group", "is_protein_altering", "reference_assembly",
        "chromosome", "start_position", "end_position", "reference_allele", "tumor_seq_allele", "hgvsp", "transcript_id")


_N = ge._N
_MUTATION_SQL = f"""SELECT *, CASE WHEN {_N} IN {ge._in(ge.m_ops.PROTEIN_ALTERING)} THEN 'protein_altering' WHEN {_N} IN {ge._in(ge.m_ops.SYNONYMOUS)} THEN 'synonymous'
      WHEN {_N} IN {ge._in(ge.m_ops.NON_CODING)} THEN 'non_coding_or_regulatory' ELSE 'unclassified' END AS consequence_group, {_N} IN {ge._in(ge.m_ops.PROTEIN_ALTERING)} AS is_protein_altering
    FROM (SELECT 'P2' AS project_id, 'C' || user_id AS case_id, CASE WHEN user_id % 3 = 0 THEN 'BAR' || user_id ELSE 'U' || user_id || 'a' END AS sample_id, 'BAR' || user_id AS source_sample_id,
      'G' || k % 20 AS gene_symbol, {v._list(v.VARIANT_CLASSES)}[k % 10 + 1] AS variant_classification, 'GRCh38' AS reference_assembly, 'chr' || k % 5 AS chromosome,
      CASE WHEN k % 13 <> 0 THEN k END AS start_position, CASE WHEN k % 13 <> 0 THEN k END AS end_position, 'A' AS reference_allele, 'T' AS tumor_seq_allele, CASE WHEN k % 3 <> 0 THEN 'p.K1N' END AS hgvsp,
      NULL::VARCHAR AS transcript_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


# ---------------------------------------------------------------- matrices and counts

#: Samples of a file that the capped landings keep.
MATRIX_CAP, COUNT_CAP = 10, 12


def _matrix_rows(s, d, value: str):
    """(cohort, gene, cells): one cell for each sample of the dense table in order of its name, blank where unmeasured; and the names."""
    rows = st.dense(s, d)
    arms, units = F.array(F.lit("a"), F.lit("n"), F.lit("t")), st.unit_count(s, d, "dense")
    names = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(units - 1)), lambda u: F.transform(arms, lambda arm: F.concat(arm, F.lit("-U"), u))))
    # a blank for each column and the measured cells take their places by one sort of the line: looking every name up would cost its width squared
    place = F.substring("unit_id", 2, 20).cast("long") * 3 + F.array_position(arms, F.col("_arm")) - 1
    held = rows.select("cancer_type", "gene_symbol", place.alias("_place"), F.col(value).cast("string").alias("_cell"))
    blank = rows.select("cancer_type", "gene_symbol").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3 * units - 1).cast("long"))).alias("_place"), F.lit("").alias("_cell"))
    cells = blank.unionByName(held).groupBy("cancer_type", "gene_symbol", "_place").agg(F.max("_cell").alias("_cell"))
    # one entry for each column of the file; a line is as wide as its file
    lines = cells.groupBy("cancer_type", "gene_symbol").agg(F.sort_array(F.collect_list(F.struct("_place", "_cell"))).alias("_line"))
    return lines.select("cancer_type", "gene_symbol", F.col("_line._cell").alias("cells")), names


def matrix_path(s, d):
    lines, names = _matrix_rows(s, d, "native_value")
    gene = F.concat(F.lit("ENSG"), F.regexp_extract("gene_symbol", r"(\d+)", 1), F.lit(".7"))
    body = lines.select(F.col("cancer_type").alias("name"), F.concat(F.concat_ws("\t", F.lit("0"), gene, "gene_symbol"), F.lit("\t"), F.array_join("cells", "\t")).alias("value"))
    head = F.concat(F.lit("id\tName\tDescription\t"), F.array_join(F.transform(names, lambda n: F.concat(F.lit("GTEX-"), "name", F.lit("-"), n)), "\t"))
    return _write_lines(_with_headers(body, [F.lit("#1.3"), F.lit("25\t48"), head]), "matrix")


def _tissues(s):
    return s.createDataFrame([(x, f"{x} tissue") for x in v.SEGMENTS], "file_name string, tissue_site string")


@v.mart("landed_matrix")
def landed_matrix(s, d):
    """All samples of all arms."""
    raw = land.lines(s, matrix_path(s, d), folders=True)
    require_none(land.malformed_matrices(raw), "malformed matrix file")
    return land.land_matrix(raw, _tissues(s))


def capped_matrix(s, d):
    return land.land_matrix(land.lines(s, matrix_path(s, d), folders=True), _tissues(s), cap=MATRIX_CAP)


def attributes(s, d):
    samples = landed_matrix(s, d).select("gtex_sample_id", "tissue_site").distinct()
    return samples.select(F.col("gtex_sample_id").alias("SAMPID"), F.when(F.col("gtex_sample_id").endswith("U3"), "elsewhere").otherwise(F.col("tissue_site")).alias("SMTSD"))


v.SQL_VIEWS["matrix"] = (("dense",), f"""
    SELECT 'GTEX-' || c || '-' || y AS gtex_sample_id, 'GTEX-' || c AS donor_id, c || ' tissue' AS tissue_site, c || ' tissue' AS tissue_detail, 'ENSG' || regexp_extract(g, '(\\d+)', 1) AS gene_id, g AS gene_symbol,
           coalesce(native_value, 0) AS expression_value, 'TPM' AS expression_unit, log2(coalesce(native_value, 0) + 1) AS log2_expression, 'v8' AS source_version, k AS _place
    FROM (SELECT DISTINCT cancer_type AS c, gene_symbol AS g FROM dense),
         (SELECT a || '-U' || i AS y, 3 * i + p AS k FROM range(0, {st._unit_count_sql('dense')}) r(i), (VALUES ('a', 0), ('n', 1), ('t', 2)) arms(a, p))
    LEFT JOIN dense ON cancer_type = c AND gene_symbol = g AND sample_id = y""")


def counts(s, d, cap=None):
    lines, names = _matrix_rows(s, d, "recount_value")
    gene = F.concat(F.lit("ENSG"), F.regexp_extract("gene_symbol", r"(\d+)", 1), F.lit(".1"))
    body = lines.select(F.col("cancer_type").alias("name"), F.concat(gene, F.lit("\t"), F.array_join("cells", "\t")).alias("value"))
    head = F.concat(F.lit("gene_id\t"), F.array_join(F.transform(names, lambda n: F.concat("name", F.lit("-"), n)), "\t"))
    path = _write_lines(_with_headers(body, [F.lit("##annotation=G029"), F.lit("##date=2020"), head]), "counts")
    samples = st.dense(s, d).select("cancer_type", "unit_id", "sample_id", "_arm").distinct()
    identity = F.concat_ws("-", "cancer_type", "sample_id").alias("sample_id")
    normal = F.col("_arm") == "n"
    metadata = samples.select(
        identity, F.concat_ws(" ", "cancer_type", "_arm").alias("cohort"), F.when(normal, "GTEX").otherwise("TCGA").alias("source"), F.when(normal, "").otherwise(F.col("cancer_type")).alias("project_id"),
        F.when(normal, "Normal").when(F.col("_arm") == "t", "Primary Tumor").otherwise("Solid Tissue Normal").alias("sample_type"), F.when(normal, F.concat("cancer_type", F.lit(" tissue"))).otherwise("").alias("tissue_site"))
    qc = samples.select(identity, (F.substring("unit_id", 2, 9).cast("double") * 1e7).alias("auc"))
    selected = land.select_count_samples(metadata, qc, cap=cap)
    annotation = st.dense(s, d).select(F.concat(F.lit("ENSG"), F.regexp_extract("gene_symbol", r"(\d+)", 1), F.lit(".1")).alias("raw_gene_id"), "gene_symbol").distinct()
    return rounded(land.land_counts(land.lines(s, path, folders=True), selected, annotation))


def _counts_sql(cap: int | None) -> str:
    first = f"QUALIFY row_number() OVER (PARTITION BY cancer_type, _arm ORDER BY cancer_type || '-' || sample_id) <= {cap}" if cap else ""
    return f"""SELECT CASE _arm WHEN 'n' THEN 'GTEX' ELSE 'TCGA' END AS source, CASE _arm WHEN 'n' THEN '' ELSE cancer_type END AS project_id, cancer_type || '-' || sample_id AS sample_id,
    CASE _arm WHEN 'n' THEN 'Normal' WHEN 't' THEN 'Primary Tumor' ELSE 'Solid Tissue Normal' END AS sample_type, CASE _arm WHEN 'n' THEN cancer_type || ' tissue' ELSE '' END AS tissue_site, 'ENSG' || regexp_extract(gene_symbol, '(\\d+)', 1) AS gene_id,
    gene_symbol, round(recount_value * (4e7::DOUBLE / (CAST(substr(unit_id, 2) AS DOUBLE) * 1e7::DOUBLE)), 6) AS expression_value, 'AUC-scaled coverage count (40M target)' AS expression_unit, 'G029' AS external_annotation
    FROM dense JOIN (SELECT cancer_type, _arm, sample_id FROM (SELECT DISTINCT cancer_type, _arm, unit_id, sample_id FROM dense WHERE unit_id <> 'U0') {first}) USING (cancer_type, _arm, sample_id)"""


# ---------------------------------------------------------------- annotation, gene sets, metadata

def annotation(s, d):
    part = v.table(s, d, "part")
    text = F.concat(F.lit('gene_id "ENSG'), "p_partkey", F.lit('.'), "p_size", F.lit('"; gene_type "x"; gene_name "'), "p_name", F.lit('";'))
    kind = F.explode(F.array(F.lit("gene"), F.lit("transcript")))
    line = part.select(text.alias("t"), kind.alias("k")).select(F.lit("gtf").alias("name"), F.concat_ws("\t", F.lit("chr1"), F.lit("src"), "k", F.lit("1"), F.lit("2"), F.lit("."), F.lit("+"), F.lit("."), "t").alias("value"))
    return land.land_annotation(land.lines(s, _write_lines(_with_headers(line, [F.lit("##description")]), "gtf"), folders=True))


def _gmt(s, d):
    sets = v.gene_sets(s, d).groupBy("pathway_id", "pathway_name").agg(F.concat_ws("\t", F.collect_list(F.lower("gene_symbol"))).alias("g"))
    named = sets.select(F.lit("gmt").alias("name"), F.concat_ws("\t", "pathway_name", F.when(F.col("pathway_id").endswith("5"), F.concat(F.lit("see R-HSA-"), F.substring("pathway_id", 5, 9))).otherwise("na"), "g", F.lit("")).alias("value"))
    return land.lines(s, _write_lines(named, "gmt"), folders=True)


def _json_hits(s, d):
    m = ge.manifest(s, d)
    slices = F.explode(F.when(F.col("data_category").startswith("T"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    case = F.struct("case_id", F.struct("project_id").alias("project"), F.array(F.struct("sample_id", "sample_type")).alias("samples"))
    hits = m.withColumn("slice", slices).select(
        "file_id", "file_name", "data_category", "data_type", F.when(F.col("access") == "controlled", F.col("access")).alias("access"), F.col("file_size").cast("bigint").alias("file_size"), "slice",
        F.struct(F.lit("STAR").alias("workflow_type")).alias("analysis"), F.array(case).alias("cases"))
    path = scratch_path(s, "hits")
    hits.write.json(path)
    return land.land_file_metadata(s.read.schema(land.HIT_SCHEMA).json(path))


@v.mart("file_records")
def file_records(s, d):
    return _json_hits(s, d)


_RECORD_SQL = """SELECT project_id, case_id, 'Unknown' AS submitter_id, sample_id, sample_type, 'Unknown' AS primary_site, 'Unknown' AS disease_type, file_id, file_name, data_category, data_type,
    'Unknown' AS experimental_strategy, 'STAR' AS workflow_type, access, CAST(file_size AS BIGINT) AS file_size, '' AS md5sum, CASE WHEN data_category LIKE 'T%' THEN 1 ELSE 2 END AS slice FROM manifest"""


# ---------------------------------------------------------------- sinks

def manifest_sink(s, d):
    path = scratch_path(s, "manifest")
    sinks.write_manifest(ge.manifest(s, d), path)
    return land.read_delimited(s, path, schema="id string, filename string, md5 string, size bigint, state string")


def graph_sink(s, d):
    path = scratch_path(s, "graph")
    sinks.write_graph(ge.nodes(s, d), ge.edges(s, d), path)
    return s.read.option("header", True).csv(f"{path}/nodes").select("node_id", "node_label", "name", "primary_site", "source")


def bulk_sink(s, d):
    path = scratch_path(s, "bulk")
    sinks.write_graph_bulk(ge.nodes(s, d), ge.edges(s, d), path)
    edges = s.read.option("header", True).schema("source_id string, target_id string, weight double, evidence_source string, edge_type string").csv(f"{path}/edges")
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 4).alias("weight"), F.count_distinct("source_id").alias("sources"))


def table_sink(s, d):
    path = scratch_path(s, "table")
    sinks.write_table(v.tumour(s, d).where("sample_type = 'Primary Tumor'"), path, partition_by=("project_id",), sort_by=("gene_symbol",))
    sinks.write_table(v.tumour(s, d), path, partition_by=("project_id",), sort_by=("gene_symbol",))  # replaces the version before
    back = sinks.read_table(s, path)
    return rounded(back.where("project_id = 'BUILDING' and gene_symbol = 'BRAND#12_PROMO'").groupBy("project_id", "sample_type").agg(
        F.count(F.lit(1)).alias("rows"), F.max("expression_value").alias("largest")))


def report_sink(s, d):
    path = scratch_path(s, "report")
    sinks.write_report(ge.s_ops.label_counts(gs.enrichment(s, d), "enrichment_tier"), path)
    return s.read.schema("enrichment_tier string, row_count bigint").json(f"{path}/json")


# ---------------------------------------------------------------- conformance

def _quant(s, d):
    """Measurements with a file per line number, so that some samples come from several files."""
    return v.tumour(s, d).select("project_id", F.regexp_extract("sample_id", r"^(S\d+)", 1).alias("sample_id"), "gene_id", "expression_unit", "pipeline_workflow",
                                 F.concat(F.lit("file"), F.regexp_extract("sample_id", r"-(\d+)$", 1)).alias("data_origin"), "expression_value")


v.SQL_VIEWS["quant"] = (("tumour",), r"""
    SELECT project_id, regexp_extract(sample_id, '^(S\d+)', 1) AS sample_id, gene_id, 'TPM' AS expression_unit, 'STAR - Counts' AS pipeline_workflow, 'file' || regexp_extract(sample_id, '-(\d+)$', 1) AS data_origin, expression_value FROM tumour""")


def caps(s):
    rows = [(x, "expression", 40) for x in v.SEGMENTS] + [("BUILDING", "expression_normal", 15), ("FURNITURE", "mutations", 0)]
    return s.createDataFrame(rows, "project_id string, bucket string, cap int")


def listing(s, d):
    """A file listing that lacks some of the manifest's files."""
    return ge.manifest(s, d).where(F.substring("md5sum", 1, 1) > "3").select("file_name", F.concat(F.lit("/data/"), "project_id", F.lit("/"), "file_name").alias("path"))


_SUPPORTED = "access = 'open' AND data_type IN ('Gene Expression Quantification', 'Masked Somatic Mutation')"
_MODALITY = "CASE WHEN data_category LIKE 'T%' THEN 'expression' ELSE 'mutations' END"


def reprocessed_parts(s, d):
    parts = [v.reprocessed(s, d).where(F.col("source") == "TCGA").drop("tissue_site"), v.reprocessed(s, d).where(F.col("source") == "GTEX").drop("project_id")]
    shaped = c_ops.conform_reprocessed(c_ops.union_parts(parts).withColumn("expression_value", F.when(F.col("expression_value") > 45, -1.0).otherwise(F.col("expression_value"))))
    return rounded(shaped.groupBy("source", "project_id", "tissue_site", "sample_type").agg(F.count(F.lit(1)).alias("rows"), F.max("expression_value").alias("largest")))


QUERIES = {
    "landing_expression_files": lambda s, d: rounded(expression_files(s, d)),
    "landing_reference_files": reference_files,
    "landing_mutation_files": mutation_files,
    "landing_expression_matrix": lambda s, d: rounded(landed_matrix.fresh(s, d).drop("data_origin")),
    "landing_matrix_report": lambda s, d: land.matrix_report(landed_matrix(s, d)),
    "landing_tissue_mismatches": lambda s, d: land.tissue_mismatches(landed_matrix(s, d), attributes(s, d)),
    "landing_expression_matrix_capped": lambda s, d: rounded(capped_matrix(s, d).drop("data_origin")),
    "landing_scaled_counts": counts,
    "landing_scaled_counts_capped": lambda s, d: counts(s, d, COUNT_CAP),
    "landing_gene_annotation": annotation,
    "landing_gene_sets": lambda s, d: land.land_gene_sets(_gmt(s, d)),
    "landing_gene_set_structure": lambda s, d: land.gene_set_structure(_gmt(s, d)),
    "landing_file_metadata": lambda s, d: land.first_slice_wins(_json_hits(s, d)),
    "landing_slice_audit": lambda s, d: land.slice_audit(file_records(s, d)),
    "sink_manifest": manifest_sink,
    "sink_graph_tables": graph_sink,
    "sink_graph_bulk": bulk_sink,
    "sink_partitioned_table": table_sink,
    "sink_report": report_sink,
    "conform_dimensions": lambda s, d: c_ops.dimension(ge.manifest(s, d), ["project_id", "case_id"]),
    "conform_file_manifest": lambda s, d: c_ops.file_manifest(ge.manifest(s, d)),
    "conform_latest_snapshot": lambda s, d: c_ops.latest_snapshot(v.table(s, d, "orders"), "o_orderdate").select("o_orderkey"),
    "conform_gene_ids": lambda s, d: v.table(s, d, "part").select("p_partkey", c_ops.strip_gene_version(
        F.concat(F.lit("ENSG"), "p_partkey", F.lit("."), "p_size", F.when(F.col("p_size") % 2 == 0, "_PAR_Y").otherwise(""))).alias("gene_id")),
    "conform_donor_ids": lambda s, d: v.table(s, d, "customer").select("c_custkey", c_ops.donor_id(
        F.concat(F.when(F.col("c_nationkey") < 12, "GTEX-").otherwise("OTHER-"), "c_custkey", F.lit("-0001"))).alias("donor_id")),
    "conform_log2_values": lambda s, d: rounded(v.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg(land.log2p1(F.col("l_extendedprice"))).alias("mean_log2"))),
    "conform_one_file_per_sample": lambda s, d: c_ops.one_file_per_sample(_quant(s, d)),
    "conform_mixed_workflows": lambda s, d: c_ops.mixed_workflows(_quant(s, d).withColumn("pipeline_workflow", F.col("data_origin"))),
    "conform_duplicate_measurements": lambda s, d: c_ops.duplicate_measurements(_quant(s, d)),
    "conform_valid_expression": lambda s, d: c_ops.valid_expression(v.tumour(s, d).withColumn("gene_id", F.when(F.col("data_origin") == "", " ").otherwise(F.col("gene_id")))).groupBy("project_id").agg(F.count(F.lit(1)).alias("rows")),
    "conform_cohort_tissue_map": lambda s, d: v.reference(s, d).join(v.cohorts(s), "tissue_site").groupBy("cancer_type", "tissue_site").agg(F.count(F.lit(1)).alias("rows")),
    "capped_file_selection": lambda s, d: c_ops.capped_selection(ge.manifest(s, d), caps(s)).select("project_id", "bucket", "file_id", "file_name"),
    "paired_case_selection": lambda s, d: c_ops.paired_selection(ge.manifest(s, d)).select("project_id", "case_id", "file_id"),
    "resolved_expression_files": lambda s, d: c_ops.resolve_files(ge.manifest(s, d), listing(s, d)).select("project_id", "file_id", "file_name", "data_origin"),
    "mutation_profile_builder": lambda s, d: c_ops.mutation_profile(ge.manifest(s, d), listing(s, d)),
    "reprocessed_conformance": reprocessed_parts,
}

SQL = {
    "landing_expression_files": _EXPRESSION_SQL,
    "landing_reference_files": v.sql(_REFERENCE_SQL, "reference"),
    "landing_mutation_files": _MUTATION_SQL,
    "landing_expression_matrix": v.sql(v.rounds("expression_value log2_expression", "(SELECT * EXCLUDE _place FROM matrix)"), "matrix"),
    "landing_expression_matrix_capped": v.sql(v.rounds("expression_value log2_expression", f"(SELECT * EXCLUDE _place FROM matrix WHERE _place < {MATRIX_CAP})"), "matrix"),
    "landing_matrix_report": v.sql("SELECT tissue_site, count(*) AS row_count, count(DISTINCT gtex_sample_id) AS sample_count, count(DISTINCT gene_id) AS gene_count FROM matrix GROUP BY 1", "matrix"),
    "landing_tissue_mismatches": v.sql("SELECT DISTINCT gtex_sample_id, tissue_site, 'elsewhere' AS declared FROM matrix WHERE gtex_sample_id LIKE '%U3'", "matrix"),
    "landing_scaled_counts": v.sql(_counts_sql(None), "dense"),
    "landing_scaled_counts_capped": v.sql(_counts_sql(COUNT_CAP), "dense"),
    "landing_gene_annotation": "SELECT 'ENSG' || p_partkey || '.' || p_size AS raw_gene_id, upper(p_name) AS gene_symbol FROM part",
    "landing_gene_sets": v.sql("SELECT CASE WHEN pathway_id LIKE '%5' THEN 'R-HSA-' || substr(pathway_id, 5) ELSE pathway_id END AS pathway_id, pathway_name, pathway_source, gene_symbol FROM gene_sets", "gene_sets"),
    "landing_gene_set_structure": v.sql("SELECT count(DISTINCT pathway_id) AS set_lines, 0::BIGINT AS short_lines, count(*) + count(DISTINCT pathway_id) AS member_entries, true AS accepted FROM gene_sets", "gene_sets"),
    "landing_file_metadata": v.sql(_RECORD_SQL, "manifest"),
    "landing_slice_audit": v.sql("""SELECT 1 AS slice, count(*) FILTER (data_category LIKE 'T%') AS record_count, 0::BIGINT AS duplicate_count FROM manifest
        UNION ALL SELECT 2, count(*), count(*) FILTER (data_category LIKE 'T%') FROM manifest""", "manifest"),
    "sink_manifest": v.sql("SELECT file_id AS id, file_name AS filename, md5sum AS md5, CAST(file_size AS BIGINT) AS size, 'released' AS state FROM manifest", "manifest"),
    "sink_graph_tables": v.sql("SELECT * FROM nodes", "nodes"),
    "sink_graph_bulk": v.sql("SELECT edge_type, count(*) AS edges, round(sum(weight), 4) AS weight, count(DISTINCT source_node_id) AS sources FROM edges GROUP BY 1", "edges"),
    "sink_partitioned_table": v.sql("""SELECT project_id, sample_type, count(*) AS rows, round(max(expression_value), 6) AS largest FROM tumour
        WHERE project_id = 'BUILDING' AND gene_symbol = 'BRAND#12_PROMO' GROUP BY 1, 2""", "tumour"),
    "sink_report": v.sql("SELECT enrichment_tier, count(*) AS row_count FROM enrichment GROUP BY 1", "enrichment"),
    "conform_dimensions": v.sql("SELECT DISTINCT project_id, case_id FROM manifest", "manifest"),
    "conform_file_manifest": v.sql("""SELECT project_id, case_id, sample_id, file_id, file_name, data_category, data_type, NULL::VARCHAR AS experimental_strategy, NULL::VARCHAR AS workflow_type, access,
        TRY_CAST(file_size AS BIGINT) AS file_size, md5sum FROM manifest""", "manifest"),
    "conform_latest_snapshot": "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
    "conform_gene_ids": "SELECT p_partkey, 'ENSG' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '_PAR_Y' ELSE '' END AS gene_id FROM part",
    "conform_donor_ids": "SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 'GTEX-' || c_custkey END AS donor_id FROM customer",
    "conform_log2_values": "SELECT l_returnflag, round(avg(log2(l_extendedprice + 1)), 6) AS mean_log2 FROM lineitem GROUP BY 1",
    "conform_one_file_per_sample": v.sql("SELECT q.* FROM quant q JOIN (SELECT project_id, sample_id, min(data_origin) AS data_origin FROM quant GROUP BY 1, 2) USING (project_id, sample_id, data_origin)", "quant"),
    "conform_mixed_workflows": v.sql("SELECT project_id, sample_id, expression_unit, count(DISTINCT data_origin) AS workflows FROM quant GROUP BY 1, 2, 3 HAVING count(DISTINCT data_origin) > 1", "quant"),
    "conform_duplicate_measurements": v.sql("SELECT project_id, sample_id, expression_unit, gene_id, count(*) AS copies FROM quant GROUP BY 1, 2, 3, 4 HAVING count(*) > 1", "quant"),
    "conform_valid_expression": v.sql("SELECT project_id, count(*) AS rows FROM tumour WHERE data_origin <> '' GROUP BY 1", "tumour"),
    "conform_cohort_tissue_map": v.sql("SELECT cancer_type, tissue_site, count(*) AS rows FROM mapped_reference GROUP BY 1, 2", "mapped_reference"),
    "capped_file_selection": v.sql(f"""SELECT project_id, bucket, file_id, file_name FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id, bucket ORDER BY file_id, file_name) AS place FROM (
          SELECT *, CASE WHEN project_id = 'BUILDING' AND data_category LIKE 'T%' AND sample_type = 'Solid Tissue Normal' THEN 'expression_normal' ELSE {_MODALITY} END AS bucket FROM manifest WHERE {_SUPPORTED}))
        WHERE CASE WHEN bucket = 'expression' THEN place <= 40 WHEN bucket = 'expression_normal' THEN place <= 15 WHEN project_id = 'FURNITURE' THEN place <= 0 ELSE true END""", "manifest"),
    "paired_case_selection": v.sql(f"""SELECT project_id, case_id, file_id FROM manifest m WHERE {_SUPPORTED} AND data_category LIKE 'T%' AND sample_type = 'Primary Tumor'
        AND EXISTS (SELECT 1 FROM manifest n WHERE n.project_id = m.project_id AND n.case_id = m.case_id AND n.access = 'open' AND n.data_category LIKE 'T%' AND n.sample_type = 'Solid Tissue Normal')""", "manifest"),
    "resolved_expression_files": v.sql(f"SELECT project_id, file_id, file_name, '/data/' || project_id || '/' || file_name AS data_origin FROM manifest WHERE {_SUPPORTED} AND data_category LIKE 'T%' AND substr(md5sum, 1, 1) > '3'", "manifest"),
    "mutation_profile_builder": v.sql(f"""SELECT project_id, file_id, sample_id, case_id, file_name, file_size, md5sum, '/data/' || project_id || '/' || file_name AS data_origin, 'downloaded' AS profile_status
        FROM manifest WHERE {_SUPPORTED} AND data_category NOT LIKE 'T%' AND substr(md5sum, 1, 1) > '3'""", "manifest"),
    "reprocessed_conformance": v.sql("""SELECT source, project_id, tissue_site, sample_type, count(*) AS rows, round(max(expression_value), 6) AS largest FROM reprocessed WHERE expression_value <= 45 GROUP BY 1, 2, 3, 4""", "reprocessed"),
}
