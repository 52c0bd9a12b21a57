"""How plans are cut and iterated."""
