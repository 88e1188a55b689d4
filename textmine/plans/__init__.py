"""Compositions of operators: feature sets, experiments and the registered queries."""
