"""Landing, conformance, quality, reads and release on small files and frames."""

import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from frames import tumour_rows
from contrastry.operators import conform as c_ops
from contrastry.operators import lookups as l_ops
from contrastry.operators import quality as q_ops
from contrastry.operators import release as x_ops
from contrastry.sources import landing as land
from contrastry.sources import listing, sinks


def _file(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    if zipped:
        with gzip.open(path, "wt") as out:
            out.write(text)
    else:
        path.write_text(text)
    return path


def test_matrix_landing_caps_strips_versions_and_checks(spark, tmp_path):
    text = "#1.3\n2\t3\nid\tName\tDescription\tGTEX-A-1\tGTEX-B-1\tGTEX-C-1\n0\tENSG1.5\tG1\t1\t3\tx\n1\tENSG2.1_PAR_Y\tG2\t0\t7\t9\n"
    _file(tmp_path / "m" / "lung.gct.gz", text, zipped=True)
    raw = land.lines(spark, str(tmp_path / "m"))
    tissues = spark.createDataFrame([("lung.gct.gz", "Lung")], "file_name string, tissue_site string")
    assert land.malformed_matrices(raw).count() == 0
    got = {(r.gene_id, r.gtex_sample_id): r for r in land.land_matrix(raw, tissues, cap=2).collect()}
    assert set(got) == {("ENSG1", "GTEX-A-1"), ("ENSG1", "GTEX-B-1"), ("ENSG2_PAR_Y", "GTEX-A-1"), ("ENSG2_PAR_Y", "GTEX-B-1")}
    assert got[("ENSG1", "GTEX-B-1")].log2_expression == 2.0 and got[("ENSG1", "GTEX-A-1")].donor_id == "GTEX-A"
    landed = land.land_matrix(raw, tissues)
    assert {r.expression_value for r in landed.where("gtex_sample_id = 'GTEX-C-1'").collect()} == {0.0, 9.0}
    wrong = spark.createDataFrame([("GTEX-A-1", "Lung"), ("GTEX-B-1", "Breast")], "SAMPID string, SMTSD string")
    assert {r.gtex_sample_id for r in land.tissue_mismatches(landed, wrong).collect()} == {"GTEX-B-1", "GTEX-C-1"}
    _file(tmp_path / "bad" / "x.gct", "nope\n")
    assert land.malformed_matrices(land.lines(spark, str(tmp_path / "bad"))).count() == 1


def test_expression_layouts_and_units(spark, tmp_path):
    _file(tmp_path / "e" / "star.tsv", "# gene-model\ngene_id\tgene_name\tunstranded\ttpm_unstranded\nN_unmapped\t\t9\t9\nENSG1.2\tTP53\t5\t3.0\n")
    _file(tmp_path / "e" / "counts.tsv", "gene_id\tcount\n__no_feature\t4\nENSG2.1\t8\n")
    _file(tmp_path / "e" / "fpkm.tsv", "sample_id\tgene\tsymbol\tfpkm\nSX\tENSG3\tEGFR\tbad\n")
    manifest = spark.createDataFrame([("star.tsv", "P", "c", "s1", "Primary Tumor", "STAR - Counts"), ("counts.tsv", "P", "c", "s2", "Primary Tumor", "HTSeq - Counts")],
                                     "file_name string, project_id string, case_id string, sample_id string, sample_type string, workflow_type string")
    got = {r.gene_id: r for r in land.land_expression_files(land.lines(spark, str(tmp_path / "e")), manifest).collect()}
    assert set(got) == {"ENSG1", "ENSG2", "ENSG3"}
    assert (got["ENSG1"].expression_value, got["ENSG1"].expression_unit, got["ENSG1"].gene_symbol) == (3.0, "TPM", "TP53")
    assert (got["ENSG2"].expression_value, got["ENSG2"].expression_unit, got["ENSG2"].gene_symbol) == (8.0, "COUNT", "ENSG2.1")
    assert (got["ENSG3"].sample_id, got["ENSG3"].expression_value, got["ENSG3"].expression_unit, got["ENSG3"].project_id) == ("SX", 0.0, "FPKM", "Unknown")


def test_a_gene_named_like_a_column_is_data(spark, tmp_path):
    _file(tmp_path / "g" / "a.tsv", "# made\ngene\tcount\nENSG7\t1\ngene\t2\ngene_id\t3\n")
    manifest = spark.createDataFrame([("a.tsv", "P", "c", "s", "Primary Tumor", "HTSeq - Counts")],
                                     "file_name string, project_id string, case_id string, sample_id string, sample_type string, workflow_type string")
    got = land.land_expression_files(land.lines(spark, str(tmp_path / "g")), manifest)
    assert sorted(r.expression_value for r in got.collect()) == [1.0, 2.0, 3.0]


def test_reference_csv_defaults(spark, tmp_path):
    _file(tmp_path / "r" / "a.csv", "sample,tissue,gene_id,tpm\nGTEX-1A-2,Lung,ENSG5.1,1\nother,Lung,ENSG5.1,\n")
    got = land.land_reference_files(land.lines(spark, str(tmp_path / "r"))).orderBy("gtex_sample_id").collect()
    assert (got[0].donor_id, got[0].gene_id, got[0].expression_unit, got[0].log2_expression, got[0].gene_symbol) == ("GTEX-1A", "ENSG5", "TPM", 1.0, "Unknown")
    assert got[1].donor_id == "Unknown" and got[1].expression_value == 0.0


@pytest.mark.parametrize("registered, expected", [(["U1"], "U1"), (["U1", "U2"], "BAR")])
def test_mutation_landing_and_canonical_sample(spark, tmp_path, registered, expected):
    text = "#version 2.4\nHugo_Symbol\tTumor_Sample_Barcode\tcase_id\tVariant_Classification\tStart_Position\tHGVSp\nTP53\tBAR\tc1\tMissense_Mutation\t12\t \nTP53\tBAR\tc1\tSilent\tx\tp.1\n"
    _file(tmp_path / "m" / "a.maf.gz", text, zipped=True)
    metadata = spark.createDataFrame([("P", "c1", s, "a.maf.gz", "Simple Nucleotide Variation", "Masked Somatic Mutation", "open") for s in registered],
                                     "project_id string, case_id string, sample_id string, file_name string, data_category string, data_type string, access string")
    rows = land.canonical_samples(land.land_mutations(land.lines(spark, str(tmp_path / "m"))), metadata).orderBy("variant_classification").collect()
    assert (rows[0].sample_id, rows[0].source_sample_id, rows[0].project_id, rows[0].start_position, rows[0].end_position, rows[0].hgvsp) == (expected, "BAR", "P", 12, 12, None)
    assert rows[0].is_protein_altering and rows[1].start_position is None and rows[1].reference_assembly == "Unknown"


def test_annotation_and_scaled_counts(spark, tmp_path):
    _file(tmp_path / "g" / "a.gtf", '#c\nchr1\tx\tgene\t1\t2\t.\t+\t.\tgene_id "ENSG1.1"; gene_name "GeneA";\nchr1\tx\texon\t1\t2\t.\t+\t.\tgene_id "ENSG2.1"; gene_name "B";\n')
    annotation = land.land_annotation(land.lines(spark, str(tmp_path / "g")))
    assert [tuple(r) for r in annotation.collect()] == [("ENSG1.1", "GENEA")]
    _file(tmp_path / "c" / "counts.tsv", "##a\n##b\ngene_id\ts1\ts2\nENSG1.1\t20\t5\n")
    selected = spark.createDataFrame([("s1", 8e7, "TCGA", "P", "Primary Tumor", "")], "sample_id string, auc double, source string, project_id string, sample_type string, tissue_site string")
    (row,) = land.land_counts(land.lines(spark, str(tmp_path / "c")), selected, annotation).collect()
    assert (row.expression_value, row.gene_symbol, row.gene_id, row.sample_id) == (10.0, "GENEA", "ENSG1", "s1")


def test_long_gene_set_names_stay_apart(spark):
    names = ["A" * 96, "long name " * 10 + "one", "long name " * 10 + "two"]
    rows = land.land_gene_sets(spark.createDataFrame([(f"{n}\tx\tg{i}",) for i, n in enumerate(names)], "value string")).orderBy("gene_symbol").collect()
    ids = [r["pathway_id"] for r in rows]
    assert ids[0] == "A" * 96 and ids[1] != ids[2] and ids[1][:96] == ids[2][:96] and all(len(i) == 109 for i in ids[1:])


def test_gene_sets(spark, tmp_path):
    _file(tmp_path / "s" / "p.gmt", "Cell cycle, mitotic\tna\ttp53\tTP53 \tEGFR\nX R-HSA-12\tna\tA\nshort\tna\n")
    raw = land.lines(spark, str(tmp_path / "s"))
    got = {r.pathway_id: r.genes for r in land.gene_set_lines(raw).collect()}
    assert got == {"CELL_CYCLE_MITOTIC": ["EGFR", "TP53"], "R-HSA-12": ["A"]}
    assert land.land_gene_sets(raw).count() == 3 and not land.gene_set_structure(raw).first().accepted


def test_nested_metadata_and_slices(spark, tmp_path):
    hit = {"file_id": "f1", "file_name": "a", "cases": [{"case_id": "c", "project": {"project_id": "P"}, "samples": [{"submitter_id": "sub", "sample_type": "Primary Tumor"}]}], "slice": 1}
    _file(tmp_path / "h" / "h.json", "\n".join(json.dumps(h) for h in (hit, {**hit, "slice": 2, "file_name": "b"}, {"id": "f2", "slice": 2})))
    records = land.land_file_metadata(spark.read.schema(land.HIT_SCHEMA).json(str(tmp_path / "h")), default_project="D")
    got = {r.file_id: r for r in land.first_slice_wins(records).collect()}
    assert (got["f1"].file_name, got["f1"].sample_id, got["f1"].access, got["f1"].file_size) == ("a", "sub", "open", 0)
    assert got["f2"].project_id == "D" and got["f2"].case_id == "Unknown"
    assert {r.slice: (r.record_count, r.duplicate_count) for r in land.slice_audit(records).collect()} == {1: (1, 0), 2: (2, 1)}


def test_absent_table_is_empty_and_sinks_round_trip(spark, tmp_path):
    assert land.read_parquet_or_empty(spark, str(tmp_path / "none"), "a string, b double").columns == ["a", "b"]
    df = spark.createDataFrame([("P", "g", 1.0)], "project_id string, gene_symbol string, v double")
    sinks.write_table(df, str(tmp_path / "t"), partition_by=("project_id",), sort_by=("gene_symbol",))
    assert sinks.read_table(spark, str(tmp_path / "t")).first().v == 1.0
    df.write.parquet(str(tmp_path / "plain"))
    assert land.read_parquet_or_empty(spark, str(tmp_path / "plain"), "project_id string, gene_symbol string, v double").first().v == 1.0
    assert land.resolve_column(df, ["x", "GENE_SYMBOL"]) == "gene_symbol" and land.resolve_column(df, ["x"]) is None


def test_file_per_sample_and_duplicates(spark):
    e = spark.createDataFrame([("P", "s", "TPM", "STAR", "b", "g1"), ("P", "s", "TPM", "STAR", "a", "g1"), ("P", "s", "TPM", "STAR", "a", "g2")],
                              "project_id string, sample_id string, expression_unit string, pipeline_workflow string, data_origin string, gene_id string")
    kept = c_ops.one_file_per_sample(e)
    assert kept.count() == 2 and c_ops.mixed_workflows(e).count() == 0
    assert c_ops.duplicate_measurements(e).count() == 1 and c_ops.duplicate_measurements(kept).count() == 0


def test_capped_and_paired_selection_is_deterministic(spark):
    rows = [("P", f"c{i % 4}", f"f{i:02d}", "n", "Transcriptome Profiling", "Gene Expression Quantification", "Solid Tissue Normal" if i % 4 == 0 else "Primary Tumor", "open") for i in range(12)]
    rows += [("P", "c0", "z", "n", "Transcriptome Profiling", "Other", "Primary Tumor", "open"), ("P", "c0", "y", "n", "Transcriptome Profiling", "Gene Expression Quantification", "Primary Tumor", "controlled")]
    m = spark.createDataFrame(rows, "project_id string, case_id string, file_id string, file_name string, data_category string, data_type string, sample_type string, access string")
    caps = spark.createDataFrame([("P", "expression", 2), ("P", "expression_normal", 1)], "project_id string, bucket string, cap int")
    got = {(r.bucket, r.file_id) for r in c_ops.capped_selection(m, caps).collect()}
    assert got == {("expression", "f01"), ("expression", "f02"), ("expression_normal", "f00")}
    assert c_ops.capped_selection(m, caps.limit(0)).count() == 12
    assert c_ops.paired_selection(m).count() == 0  # normals belong to case c0, which has no open tumour file


def test_reprocessed_conformance(spark):
    df = spark.createDataFrame([("tcga", "tp53", "1.5"), ("gtex", "a", "-1"), ("gtex", "b", "x")], "source string, gene_symbol string, expression_value string")
    (row,) = c_ops.conform_reprocessed(df).collect()
    assert (row.source, row.gene_symbol, row.external_annotation, row.sample_id) == ("TCGA", "TP53", "unknown", "")
    with pytest.raises(ValueError):
        c_ops.conform_reprocessed(df.drop("source"))


def test_quality_rules_on_bad_tables(spark):
    t = tumour_rows(spark, [("P", "c", "s", "Primary Tumor", "G", -1), ("P", "c", "s", "Primary Tumor", "G", 2)]).withColumn("expression_unit", F.lit("RPKM"))
    got = {r.check_name: r for r in q_ops.row_rules({"tumour": t}, q_ops.SILVER_RULES).collect()}
    assert got["silver_expression_tcga_non_negative"].failed_rows == 1 and got["silver_expression_tcga_unit_supported"].status == "failed"
    assert got["silver_expression_tcga_null_gene_id"].status == "passed"
    assert q_ops.duplicate_keys(t, ["project_id", "sample_id", "gene_id"], "k").first().failed_rows == 1
    assert q_ops.duplicate_keys(t, ["nope"], "k").first().status == "failed"
    assert q_ops.duplicate_known_ids(spark.createDataFrame([("a",), ("a",), ("Unknown",), ("unknown",)], "i string"), "i", "d").first().failed_rows == 1
    parent = spark.createDataFrame([("P",)], "project_id string")
    assert q_ops.orphans(t, parent, ["project_id"], "fk").first().status == "passed"
    assert q_ops.schema_presence(spark, {"projects": parent}).first().failed_rows == 2
    results = q_ops.row_rules({"tumour": t}, q_ops.SILVER_RULES)
    assert q_ops.roll_up(results).first().status == "failed" and q_ops.roll_up(results.where("status = 'passed'")).first().status == "passed"
    assert q_ops.minimum_support(t, "project_id", "sample_id", "s").first().status == "warning"
    assert q_ops.mapping_rate(t, "gene_id").first().status == "passed"


def test_rule_names_cover_the_published_report():
    names = [r.name for r in (*q_ops.SILVER_RULES, *q_ops.CONTRACT_RULES)]
    assert len(set(names)) == len(names) == 31 and len(q_ops.REQUIRED_COLUMNS) == 21


def test_file_integrity(spark, tmp_path):
    _file(tmp_path / "d" / "a.tsv", "x")
    _file(tmp_path / "d" / "b.tsv", "y")
    import hashlib
    m = spark.createDataFrame([("a.tsv", hashlib.md5(b"x").hexdigest(), "open"), ("b.tsv", "0", "open"), ("c.tsv", "0", "open"), ("d.tsv", "0", "controlled")], "file_name string, md5sum string, access string")
    got = {r.check_name: r for r in q_ops.file_integrity(m, q_ops.file_listing(spark, str(tmp_path / "d"))).collect()}
    assert got["bronze_tcga_download_file_presence"].failed_rows == 1 and got["bronze_tcga_download_checksum_match"].failed_rows == 1
    assert {r.status for r in q_ops.file_integrity(m, q_ops.file_listing(spark, str(tmp_path / "d")), partial=True).collect()} == {"warning"}


def test_digests_of_large_files_and_changes(spark, tmp_path):
    import hashlib

    from contrastry.sources import listing
    _file(tmp_path / "one" / "a b%20.tsv", "x")
    _file(tmp_path / "one" / "small.tsv", "s")
    _file(tmp_path / "one" / "empty.tsv", "")
    with open(tmp_path / "one" / "sparse.bin", "wb") as f:
        f.truncate(3 << 30)  # more than one row can hold
    before = listing.with_digests(listing.listed_files(spark, str(tmp_path / "one")))
    got = {r.file_name: r for r in before.collect()}
    assert got["a b%20.tsv"].md5 == hashlib.md5(b"x").hexdigest() and "empty.tsv" not in got
    zeros = hashlib.md5()
    for _ in range(3 << 10):
        zeros.update(bytes(1 << 20))
    assert (got["sparse.bin"].length, got["sparse.bin"].md5) == (3 << 30, zeros.hexdigest())
    # digests of unchanged files are taken over: a wrong one shows that the file was not read
    known = spark.createDataFrame([(r.path, r.file_name, r.length, r.modified, "old" if r.file_name == "sparse.bin" else r.md5) for r in got.values()], before.schema)
    _file(tmp_path / "one" / "small.tsv", "changed")
    _file(tmp_path / "one" / "new.tsv", "new")
    os.remove(tmp_path / "one" / "a b%20.tsv")
    after = listing.refreshed(listing.listed_files(spark, str(tmp_path / "one")), known)
    kinds = {r.file_name: r.change for r in listing.changes(known, after).collect()}
    assert kinds == {"a b%20.tsv": "removed", "small.tsv": "changed", "new.tsv": "added", "sparse.bin": "unchanged"}
    listing.require_unchanged(known, known)
    with pytest.raises(ValueError):
        listing.require_unchanged(known, after)


def test_leak_scan_equals_brute_force(spark):
    import random
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab\u00e9\U0001F600\n") for _ in range(n))
    texts = [word(rng.choice((0, 3, 9, 40, 900))) for _ in range(80)] * 2 + [None]
    ids = sorted({word(rng.choice((2, 3, 4, 5, 30))) for _ in range(200)} | {texts[k][5:200] for k in range(80) if texts[k] and len(texts[k]) == 900})
    want = {(i, n) for i in ids if len(i) >= 3 and (n := sum(i in t for t in texts if t))}
    frames = (spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(i,) for i in ids], "identifier string"))
    for piece, cells in ((1 << 16, 1 << 20), (7, 2)):
        got = x_ops.leaked_identifiers(*frames, min_length=3, piece=piece, cells=cells)
        assert {tuple(r) for r in got.collect()} == want
    assert x_ops.leaked_identifiers(frames[0], frames[1].limit(0)).count() == 0 == x_ops.leaked_identifiers(frames[0].limit(0), frames[1]).count()


def test_run_log_is_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    for run in ("r1", "r2", "r3"):
        record = x_ops.run_record(spark, run, "passed", f"2024-01-0{run[1]}", "", {"tumour": 3})
        sinks.append_runs(record, path)
    assert [r.run_id for r in x_ops.bounded_history(sinks.read_runs(spark, path, record.schema), keep=2).collect()] == ["r3", "r2"]


def test_forbidden_column_audit(spark):
    df = spark.createDataFrame([("a", None), (" ", "x")], "`Case ID` string, gene string")
    assert [tuple(r) for r in x_ops.forbidden_column_audit(spark, {"t": df, "u": df.select("gene")}).collect()] == [("t", "Case ID", 1)]


def test_lookup_filters_order_and_total(spark):
    df = spark.createDataFrame([("BRCA", "TP53", 0.9, 2, 0.5, 2.0, "high"), ("BRCA", "TP53BP1", 0.3, 1, 0.1, 1.0, "medium"), ("LUAD", "EGFR", 0.5, 1, 0.2, 1.0, "high")],
                               "cancer_type string, gene_symbol string, priority_score double, evidence_count long, mutation_frequency double, abs_log2_fold_change double, priority_tier string")
    got = [r.gene_symbol for r in l_ops.lookup(df, "candidate_priority", text="tp53", equal={"cancer_type": "BRCA"}).collect()]
    assert got == ["TP53", "TP53BP1"]
    assert l_ops.lookup(df, "candidate_priority", at_least={"priority_score": 0.4}, limit=1).count() == 1
    assert l_ops.total_matching(df, "candidate_priority", at_least={"priority_score": 0.4}).first()[0] == 2
    assert l_ops.lookup(df, "candidate_priority", text="T.53").count() == 0 and l_ops.matching(df, l_ops.LOOKUPS["candidate_priority"], text="T.53", regex=True).count() == 2
    with pytest.raises(ValueError):
        l_ops.lookup(df, "candidate_priority", equal={"gene_symbol": "x"})
    plan = l_ops.lookup(df, "candidate_priority")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_release_audits(spark):
    df = spark.createDataFrame([("GENE:TP53", "TCGA-AB-1234-01"), ("PATIENT:x", "fine")], "node_id string, note string")
    assert {r.column_name: r.individual_like_rows for r in x_ops.individual_values(df).collect()} == {"node_id": 1, "note": 1}
    assert x_ops.forbidden_columns(df.withColumnRenamed("note", "Case ID")) == ["Case ID"]
    for bad in (df, df.limit(0), df.select(F.lit("a").alias("sample_id"))):
        with pytest.raises(ValueError):
            x_ops.require_public(bad, "t")
    x_ops.require_public(df.select(F.lit("TP53").alias("gene_symbol")), "t")
    ids = spark.createDataFrame([("SPECIMEN-12",), ("OTHERS-99",)], "identifier string")
    texts = spark.createDataFrame([("see SPECIMEN-12, twice SPECIMEN-12.",), ("GTEX-1117F-0226.SM and TCGA-AB-1234-01A",), (None,), ("xSPECIMEN-123",)], "text string")
    ids = ids.union(spark.createDataFrame([("GTEX-1117F-0226.SM",), ("TCGA-AB-1234",), ("TCGA-AB-1234-01A",), ("short",), (None,)], "identifier string"))
    got = {tuple(r) for r in x_ops.leaked_identifiers(texts, ids).collect()}
    assert got == {("SPECIMEN-12", 2), ("GTEX-1117F-0226.SM", 1), ("TCGA-AB-1234", 1), ("TCGA-AB-1234-01A", 1)}
    same, other = x_ops.fingerprint(df).first(), x_ops.fingerprint(df.repartition(4).select("note", "node_id")).first()
    assert same == other and x_ops.fingerprint(df.limit(1)).first() != same
    plan = spark.createDataFrame([("t", same.fingerprint)], "name string, fingerprint string")
    x_ops.require_same_plan(plan, plan)
    with pytest.raises(ValueError):
        x_ops.require_same_plan(plan, plan.withColumn("fingerprint", F.lit("0")))


def test_plans_by_slice_tell_every_change(spark):
    schema = "slice long, a string, b string"
    frozen = spark.createDataFrame([(1, "x", None), (1, "y", "z"), (2, "x", None), (3, "x", "y"), (3, "x", "y"), (5, "gone", None), (None, "n", "n")], schema)
    current = spark.createDataFrame([(1, "y", "z"), (1, "x", None), (2, None, "x"), (3, "x", "y"), (4, "new", None), (None, "n", "n")], schema)
    plans = [x_ops.fingerprint(df.repartition(3), ["slice"]).where("slice IS NOT NULL") for df in (current, frozen)]
    got = {r["slice"]: tuple(r)[1:] for r in x_ops.plan_changes(*plans, ["slice"]).collect()}
    # in slice 2 a value moved between columns, in slice 3 one of two equal rows went
    assert got == {1: ("unchanged", 2, 2), 2: ("changed", 1, 1), 3: ("changed", 2, 1), 4: ("added", None, 1), 5: ("removed", 1, None)}
    empty = x_ops.fingerprint(frozen.limit(0)).withColumn("name", F.lit("t"))
    assert x_ops.plan_changes(empty, empty).first()["change"] == "unchanged"
    with pytest.raises(ValueError, match="added|removed|changed"):
        x_ops.require_same_plan(*plans, ["slice"])


def test_declared_tests_scan_each_table_once(spark):
    people = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, None, "x"), (None, "b", None), (None, "b", "q")], "id long, name string, kind string")
    declared = (
        ("people", "id", "unique"), ("people", "id", "not_null"), ("people", "name", "unique"), ("people", "name", "not_null"), ("people", "kind", "accepted_values", ("x", "y")),
        ("nobody", "id", "unique"), ("nobody", "id", "not_null"),
    )
    out = q_ops.declared_tests({"people": people, "nobody": people.limit(0)}, declared)
    assert {r.check_name: (r.status, r.failed_rows) for r in out.collect()} == {
        "people.id.unique": ("failed", 1), "people.id.not_null": ("failed", 2), "people.name.unique": ("failed", 1), "people.name.not_null": ("failed", 1),
        "people.kind.accepted_values": ("failed", 1), "nobody.id.unique": ("passed", 0), "nobody.id.not_null": ("passed", 0)}
    with pytest.raises(ValueError):
        q_ops.declared_tests({"people": people}, [("people", "id", "never")])


def test_latest_delivery_is_taken_whole(spark, tmp_path):
    path = str(tmp_path / "deliveries")
    for name, rows, at in (("z", 4, 100), ("a", 6, 300), ("m", 5, 200)):
        spark.range(rows).repartition(3).write.parquet(f"{path}/{name}")
        for i, file in enumerate(sorted((tmp_path / "deliveries" / name).glob("*.parquet"))):
            os.utime(file, (at + i, at + i))
    assert listing.latest_delivery(spark, path) == f"{path}/a" and spark.read.parquet(listing.latest_delivery(spark, path + "/")).count() == 6
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        listing.latest_delivery(spark, str(tmp_path / "none"))


def test_traceability_warns_about_unparsed_files(spark):
    outcomes = spark.createDataFrame([("P", "expression", "downloaded"), ("P", "expression", "failed"), ("P", "mutations", "downloaded")], "project_id string, modality string, status string")
    silver = spark.createDataFrame([("P", "stub/a"), ("P", "x/b")], "project_id string, data_origin string")
    got = {r.modality: r for r in x_ops.traceability(outcomes, {"expression": silver, "mutations": silver.limit(0)}).collect()}
    assert got["expression"].parsed_vs_local_file_ratio == 2.0 and got["expression"].warnings == "stub_origin_rows" and got["expression"].failed_files == 1
    assert got["mutations"].warnings == "local_files_without_parsed_rows"


def test_failed_replacement_leaves_the_table_and_readers_see_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    numbers = spark.range(1000).selectExpr("id", "id % 3 AS part")
    assert sinks.write_table(numbers, path, partition_by=("part",)) == 1
    begun = sinks.read_table(spark, path)
    with pytest.raises(Exception):
        sinks.write_table(numbers.selectExpr("IF(id = 999, raise_error('stop'), id) AS id", "part"), path)
    assert sinks.read_table(spark, path).count() == 1000
    assert sinks.write_table(numbers.where("id < 10"), path, partition_by=("part",)) == 2
    assert sinks.read_table(spark, path).count() == 10 and sinks.read_table(spark, path, 1).count() == 1000 and begun.count() == 1000


def test_wide_lines_land_in_tiles(spark):
    wide = [("f", "p", 1, ["a", "", "c", "d", "e"]), ("f", "p", 2, ["v", "w"]), ("f", "q", 3, ["x"])]
    data = spark.createDataFrame(wide, "file_name string, file_path string, gene int, _cells array<string>")
    columns = spark.createDataFrame([("p", k, f"S{k}") for k in (0, 1, 3, 4)] + [("q", 7, "S7")], "file_path string, _pos int, sample string")
    got = land.selected_cells(data, columns, ["sample"], tile=2)
    assert sorted(tuple(r) for r in got.select("gene", "sample", "_cell").collect()) == [(1, "S0", "a"), (1, "S1", ""), (1, "S3", "d"), (1, "S4", "e"), (2, "S0", "v"), (2, "S1", "w")]


def test_a_wide_line_meets_each_tile_with_its_own_cells(spark):
    data = spark.createDataFrame([("f", "g", [str(i) for i in range(2_503)]), ("f", "h", ["x"]), ("f", "e", [])], "file_path string, gene string, _cells array<string>")
    tiles = land.cell_tiles(data, tile=1_000).select("gene", "_tile", "_cells").collect()
    assert sorted((r.gene, r["_tile"], len(r["_cells"])) for r in tiles) == [("e", 0, 0), ("g", 0, 1_000), ("g", 1, 1_000), ("g", 2, 503), ("h", 0, 1)]
    columns = spark.range(3_000).where("id % 3 = 0").select(F.lit("f").alias("file_path"), F.col("id").cast("int").alias("_pos"), F.concat(F.lit("S"), "id").alias("sample"))
    got = land.selected_cells(data, columns, ["sample"]).collect()
    assert sorted((r.gene, r["sample"], r["_cell"]) for r in got) == sorted([("g", f"S{i}", str(i)) for i in range(0, 2_503, 3)] + [("h", "S0", "x")])


def test_matrix_lines_are_in_place_at_any_width(spark, monkeypatch):
    from contrastry.plans import silver, studies

    wide = 8_000
    held = spark.range(3 * wide).where("id % 7 <> 0").select(
        F.lit("BUILDING").alias("cancer_type"), F.lit("G1").alias("gene_symbol"), F.element_at(F.array(F.lit("a"), F.lit("n"), F.lit("t")), (F.col("id") % 3 + 1).cast("int")).alias("_arm"),
        F.concat(F.lit("U"), F.floor(F.col("id") / 3)).alias("unit_id"), F.col("id").cast("double").alias("native_value"))
    monkeypatch.setattr(studies, "dense", lambda s, d: held.withColumn("sample_id", F.concat_ws("-", "_arm", "unit_id")))
    monkeypatch.setattr(studies, "unit_count", lambda s, d, table: wide)
    lines, names = silver._matrix_rows(spark, "", "native_value")
    assert not any(w in lines._jdf.queryExecution().optimizedPlan().toString() for w in ("map_from_entries", "try_element_at"))  # a name is never looked up along a line
    (row,) = lines.withColumn("names", names).collect()
    assert row.cells == ["" if i % 7 == 0 else f"{i}.0" for i in range(3 * wide)]
    assert row.names[:4] == ["a-U0", "n-U0", "t-U0", "a-U1"] and len(row.names) == 3 * wide


def test_many_files_are_written_by_many_tasks_into_few_folders(spark, tmp_path):
    path = str(tmp_path / "delivered")
    df = spark.range(500).coalesce(1).select(F.concat(F.lit("F"), "id").alias("name"), F.concat(F.lit("line é "), "id", F.lit("\n")).alias("value"))
    sinks.write_files(df, path, folders=40)
    sinks.write_files(df.where("id < 100"), path, folders=40)  # tasks that run again leave the same files
    found = q_ops.file_listing(spark, path).collect()
    assert {r.file_name: r.md5 for r in found} == {f"F{i}": hashlib.md5(f"line é {i}\n".encode()).hexdigest() for i in range(500)} and len(found) == 500
    assert len(list((tmp_path / "delivered").iterdir())) <= 40 and not list((tmp_path / "delivered").glob("*/.*"))
    sinks.write_files(df.limit(0), str(tmp_path / "none"))
    assert q_ops.file_listing(spark, str(tmp_path / "none")).count() == 0


def test_lookup_opens_few_files(spark, tmp_path):
    path = str(tmp_path / "keyed")
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("G"), F.lpad((F.col("id") % 500).cast("string"), 3, "0"))).alias("gene"), F.col("id").alias("sample"))
    sinks.write_lookup(df, path, "gene", spread=("sample",), files=40)
    one = sinks.read_lookup(spark, path, "gene", "G123")
    assert one.count() == df.where("gene = 'G123'").count() and len(one.inputFiles()) <= 4
    assert "PushedFilters: [IsNotNull(gene), EqualTo(gene,G123)]" in one._jdf.queryExecution().executedPlan().toString()
    hot = sinks.read_lookup(spark, path, "gene", "HOT")
    assert hot.count() == df.where("gene = 'HOT'").count() and len(hot.inputFiles()) > 4  # a key of a third of the rows is no single file
    assert sinks.read_lookup(spark, path, "gene", "G123", "G400").count() == df.where("gene IN ('G123', 'G400')").count()
    gone = sinks.read_lookup(spark, path, "gene", "ZZZ")
    assert gone.count() == 0 and gone.schema == one.schema
    sinks.write_lookup(df.where("gene <> 'G123'"), path, "gene", files=40)
    assert sinks.read_lookup(spark, path, "gene", "G123").count() == 0 and sinks.read_lookup(spark, path, "gene", "G123", version=1).count() == one.count()


def test_marts_follow_their_inputs(spark, tmp_path):
    from contrastry.plans import views as v
    from contrastry.plans import warehouse
    built = []

    @warehouse.mart("t_first")
    def first(s, d):
        built.append("first")
        return v.table(s, d, "one").groupBy().agg(F.sum("id").alias("n"))

    @warehouse.mart("t_second")
    def second(s, d):
        built.append("second")
        return first(s, d).crossJoin(v.table(s, d, "two").groupBy().agg(F.count(F.lit(1)).alias("m"))).select((F.col("n") + F.col("m")).alias("n"))

    @warehouse.mart("t_other")
    def other(s, d):
        built.append("other")
        return v.table(s, d, "two").groupBy().agg(F.count(F.lit(1)).alias("n"))

    d = str(tmp_path)
    for name, rows in (("one", 4), ("two", 2)):
        spark.range(rows).write.parquet(f"{d}/{name}.parquet")
    ask = lambda: (other(spark, d).first().n, second(spark, d).first().n)
    assert ask() == (2, 8) == ask() and sorted(built) == ["first", "other", "second"]
    assert not {"t_first", "t_second", "t_other"} & set(warehouse.refresh(spark))
    spark.range(5).write.mode("overwrite").parquet(f"{d}/one.parquet")
    assert ask() == (2, 8)  # until asked to look
    assert warehouse.refresh(spark) == ["t_first", "t_second"]
    assert ask() == (2, 12) and sorted(built) == ["first", "first", "other", "second", "second"]


def test_cohort_summary_reads_each_table_once(spark):
    from contrastry.operators.scores import cohort_summary
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    projects, patients = t([("P",), ("P",), (None,)], "project_id string"), t([("c1",), ("c2",)], "case_id string")
    samples, manifest = t([("s1",)], "sample_id string"), t([("f1",), ("f2",), ("f2",)], "file_id string")
    tumour, reference = t([("g1",), ("g1",), (None,)], "gene_id string"), t([("g1", "r1"), ("g2", "r1")], "gene_id string, gtex_sample_id string")
    mutations = t([("s1", "Missense_Mutation", True), ("s2", "Silent", False)], "sample_id string, variant_classification string, is_protein_altering boolean")
    profile = t([], "sample_id string")
    got = cohort_summary(projects, patients, samples, manifest, tumour, reference, mutations, profile).first().asDict()
    assert got == {
        "tcga_project_count": 1, "tcga_patient_count": 2, "tcga_sample_count": 1, "tcga_file_count": 2, "gtex_expression_sample_count": 1, "tcga_expression_row_count": 3,
        "gtex_expression_row_count": 2, "gene_count": 2, "mutation_record_count": 2, "protein_altering_mutation_record_count": 1, "mutation_profiled_sample_count": 2}
    empty = cohort_summary(*[df.limit(0) for df in (projects, patients, samples, manifest, tumour, reference, mutations, profile)]).first().asDict()
    assert set(empty.values()) == {0}
