"""Whole plans: search and ingestion."""
