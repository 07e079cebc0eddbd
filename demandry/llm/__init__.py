"""Operators for preparing training data: ten Spark jobs and the queries that apply them."""
