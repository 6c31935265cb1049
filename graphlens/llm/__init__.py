"""Operators for preparing training text at scale.

The batches these operators hand to numpy arrive through Arrow, one Spark task
at a time; what has to meet across tasks meets in joins and aggregates. On a
cluster the package must be importable on the executors (`--py-files`).
"""
