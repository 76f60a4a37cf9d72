"""Spark jobs over article feeds: sources, column functions, relational operators, query plans, streams."""
