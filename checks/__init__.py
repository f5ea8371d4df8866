"""Queries over the test tables, with the SQL that DuckDB checks them by."""
