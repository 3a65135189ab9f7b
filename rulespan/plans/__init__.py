"""Programs: syntax, checks, strata, rewrites."""
