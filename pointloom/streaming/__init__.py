"""Structured Streaming forms of operators that work row by row or add up per cell."""
