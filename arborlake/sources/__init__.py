"""Where entries come from and where results go."""
