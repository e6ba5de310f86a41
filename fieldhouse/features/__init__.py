"""Point-in-time features of teams and players."""
