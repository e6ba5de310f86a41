"""Whole jobs: registered queries and the tables they read."""
