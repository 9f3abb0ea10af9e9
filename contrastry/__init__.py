"""Tumour/normal evidence engine written as Spark DataFrame operators."""
