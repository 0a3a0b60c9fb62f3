"""Findings analytics on Spark: sources, operators, functions, streams and sinks for security findings at scale."""
