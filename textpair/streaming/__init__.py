"""Structured Streaming versions of scoring and metric-log merging."""
