"""Requests and their translation to Column expressions."""
