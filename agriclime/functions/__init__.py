"""Column-level building blocks: missing values, calendar parts, aggregates."""
