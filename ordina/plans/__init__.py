"""Row order: how it is kept, and how dense positions are made without one task seeing all rows."""
