"""Operators of a training-data pipeline: filters, deduplication, tokenization, extraction.

Nothing outside this subpackage imports it. Each operator is a function from DataFrames to a
DataFrame; :mod:`txnlens.llm.queries` binds them to the tables of the test data.
"""
