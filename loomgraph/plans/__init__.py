"""Pipelines over the operators: index build, proxy tables, lineage."""
