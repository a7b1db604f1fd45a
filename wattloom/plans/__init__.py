"""Chains of operators: steps, layers, gates and reports."""
