"""Stratified Datalog on Spark DataFrames, with incremental sessions."""
