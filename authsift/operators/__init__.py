"""DataFrame -> DataFrame operators: parse, correlate, enrich, rules, rank,
analytics, evaluation, case state, model I/O, and the fixed dimension tables."""
