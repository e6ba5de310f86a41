"""Relational operators over games, teams, odds and player lines."""
