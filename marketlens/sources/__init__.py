"""Readers of tables and raw payloads, and sinks."""
