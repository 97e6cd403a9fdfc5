"""Readers of landed data and rules about sources."""
