"""Registered queries: the operators applied to the star-schema tables, with SQL twins."""
