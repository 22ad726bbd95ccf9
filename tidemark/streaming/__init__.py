"""Streams into database tables."""
