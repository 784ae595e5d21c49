"""Whole programs composed from operators: prepare, evaluate, analyse."""
