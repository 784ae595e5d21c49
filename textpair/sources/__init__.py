"""Readers and writers for datasets, result tables and metric logs."""
