"""Rules, their filters and order, and how they become DataFrame plans."""
