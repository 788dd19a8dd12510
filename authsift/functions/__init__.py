"""Column-level functions: patterns, text/time helpers, IPv4 tests, ordering."""
