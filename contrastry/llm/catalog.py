"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from contrastry.llm import bpe, decontaminate, feistel, htmltext, jaccard, linequality, periodic, resampling, sharding, substrings, toxicity, urlfilter, warc

OPERATORS = (jaccard, substrings, urlfilter, warc, linequality, feistel, sharding, decontaminate, bpe, htmltext, toxicity, resampling, periodic)

QUERIES = {name: query for operator in OPERATORS for name, query in operator.QUERIES.items()}
SQL = {name: text for operator in OPERATORS for name, text in operator.SQL.items()}
