"""Rules as DataFrames, fixpoints, signed relations."""
