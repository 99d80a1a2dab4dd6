"""DataFrame operators: curation, evaluation, statistics, sequences, code metrics and run analysis."""
