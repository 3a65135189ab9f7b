"""Scalar functions of programs as Spark columns."""
