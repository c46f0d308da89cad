"""Imports every query module so that the registry is complete."""
from workload import advice_queries, audit_queries, flagship, group_queries, metric_queries, model_queries, pair_queries, prep_queries, table_queries  # noqa: F401
