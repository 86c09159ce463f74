"""Whole analyses, the query registry and what they share."""
