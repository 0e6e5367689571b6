"""Micro-batch ingestion and its jobs."""
