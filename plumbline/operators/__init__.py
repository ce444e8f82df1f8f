"""Table-level operators: profiling, sampling, error injection, dependency weights, convergence."""
