"""Source files that do not parse (problem 1)."""
