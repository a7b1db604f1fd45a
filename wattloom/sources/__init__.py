"""Where readings come from and where results go."""
