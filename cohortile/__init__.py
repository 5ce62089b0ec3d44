"""Cohort profiling on Spark: matrices, differential features, set scores, group tests."""
