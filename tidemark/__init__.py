"""Tidemark: table readiness on Spark.

Profile a table, diagnose it, repair it with a declared list of column steps,
check the result against contracts, screen its text and analyse recorded runs.
Every operator takes and returns Spark DataFrames.
"""
