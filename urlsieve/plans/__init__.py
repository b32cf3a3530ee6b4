"""Registered queries, each with its DuckDB SQL where SQL can express it."""
