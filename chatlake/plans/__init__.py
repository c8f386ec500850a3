"""Compositions of operators: the dashboard, hybrid search, the message log, and the checked queries."""
