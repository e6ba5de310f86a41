"""Readers of landed provider files and writers of curated tables."""
