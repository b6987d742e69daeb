"""Medication-safety analytics as PySpark DataFrame jobs."""
