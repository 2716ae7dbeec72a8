"""Structured Streaming forms of the auction queries."""
