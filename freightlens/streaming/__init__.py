"""Structured Streaming jobs for the live ping feed."""
