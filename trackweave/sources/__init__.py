"""Where tracks come from and where results go."""
