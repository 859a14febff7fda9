"""Incremental and streaming forms of the operators."""
