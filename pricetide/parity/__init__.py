"""Registered queries over the benchmark tables, and their SQL equivalents."""
