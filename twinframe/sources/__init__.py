"""Where ``files`` relations come from and where results go."""
