"""Column functions: confusion statistics, intervals, text and validator predicates."""
