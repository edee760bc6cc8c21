"""Column builders: each takes and returns columns, and stays inside generated code."""
