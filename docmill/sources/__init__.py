"""Readers of document collections and sinks of results."""
