"""DataFrame operators: validation, catalog profiling, prompts, runs, scoring."""
