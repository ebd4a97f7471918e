"""Readers of delimited texts, and writers."""
