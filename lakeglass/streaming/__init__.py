"""Structured Streaming forms of the calendar operators."""
