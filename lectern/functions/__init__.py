"""Column functions: text preparation and recognition."""
