"""Soft-label and conversation analytics as PySpark DataFrame jobs."""
