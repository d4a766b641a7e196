"""The queries of the core library, each with DuckDB SQL for the same rows."""
