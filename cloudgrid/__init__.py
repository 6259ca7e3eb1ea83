"""Point clouds as Spark DataFrames.

Every point carries a uniformly random importance in [0, 1) beside its
coordinates, so one half-open range predicate answers box queries, sampling and
both together.
"""
