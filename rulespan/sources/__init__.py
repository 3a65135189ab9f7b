"""Adapters that read relations, and sinks that write them."""
