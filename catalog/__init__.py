"""The registered queries on the sample tables and their SQL equivalents."""
