"""Where events and lookup data come from."""
