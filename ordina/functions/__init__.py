"""The expression language and the aggregate functions."""
