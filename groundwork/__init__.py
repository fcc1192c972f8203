"""Grounding audits and corpus preparation on Spark DataFrames."""
