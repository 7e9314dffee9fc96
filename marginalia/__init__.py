"""Biomedical-literature analytics as Spark jobs."""
