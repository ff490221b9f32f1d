"""Peptide-sequence analytics as Spark DataFrame jobs."""
