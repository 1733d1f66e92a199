"""Where lines come from and where records go."""
