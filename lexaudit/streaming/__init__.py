"""Stateful serving rules, as Structured Streaming operators and as batch queries over event tables."""
