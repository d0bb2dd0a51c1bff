"""DataFrame -> DataFrame operators: graph, statistics, samples, overlaps, mutants, distractors, questions, resumption."""
