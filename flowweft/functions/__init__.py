"""Column functions and row numbering."""
