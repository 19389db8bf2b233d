"""From SQL text to DataFrames: lexer, parser, planner, EXPLAIN."""
