"""Batch and streaming analytics over collections of titled facts, on PySpark.

Everything works on DataFrames that carry ``user_id`` (the tenant) as a column; one
call serves all tenants at once. See README.md for the list of operations.
"""
