"""Streams of landed replies."""
