"""Usage that arrives month by month."""
