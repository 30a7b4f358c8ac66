"""Operators on documents, keyword hits and insights."""
