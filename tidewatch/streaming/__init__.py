"""Event time: the same functions serve batch tables and streams."""
