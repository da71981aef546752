"""Structured Streaming variants of the reports."""
