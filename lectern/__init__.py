"""Correcting and scoring noisy line-level text with Spark."""
