"""Compositions of operators: sampler registry, progressive curves, condition grids, results and reports."""
