"""Row-wise operators and groups on streams."""
