"""Reusable DataFrame operators: dashboard scoping (filters, semi joins,
bounded broadcasts), eager aggregation of many-to-many fan-outs, and
reshape helpers (maps keyed by data values, optional final sort)."""
