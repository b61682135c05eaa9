"""Gridded-forecast preparation and verification on Spark."""
