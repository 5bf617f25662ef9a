"""Queries over the driver's tables, each with its DuckDB SQL."""
