"""DataFrame operators: curation, generation, scoring, comparison, checkpoints."""
