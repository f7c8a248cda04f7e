"""Collaboration analytics as lazy Spark plans."""
