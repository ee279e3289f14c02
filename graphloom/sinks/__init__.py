"""Outputs: DOT, JSON and HTML."""
