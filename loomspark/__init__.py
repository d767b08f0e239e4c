"""Loomspark: a PySpark engine for narrative and conversational text."""
