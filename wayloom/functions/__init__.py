"""Column expressions and worker-side functions shared by the operators."""
