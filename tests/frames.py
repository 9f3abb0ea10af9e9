"""Small frames in the shape of the conformed tables."""

TUMOUR = "project_id string, case_id string, sample_id string, sample_type string, gene_id string, gene_symbol string, expression_value double, expression_unit string, pipeline_workflow string, data_origin string"
REFERENCE = "gtex_sample_id string, donor_id string, tissue_site string, gene_symbol string, expression_value double, data_origin string"


def tumour_rows(spark, rows):
    """rows: (project, case, sample, type, gene, value)"""
    return spark.createDataFrame([(p, c, s, t, "ENSG1", g, float(v), "TPM", "STAR - Counts", "public/star") for p, c, s, t, g, v in rows], TUMOUR)


def reference_rows(spark, rows):
    """rows: (sample, tissue, gene, value)"""
    return spark.createDataFrame([(s, s, t, g, float(v), "public/star") for s, t, g, v in rows], REFERENCE)
