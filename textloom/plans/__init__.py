"""Whole programs: from samples to evaluation, from samples to batches, and the registered queries."""
