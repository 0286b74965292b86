"""Column functions on sequences, CIGARs, qualities and distributions."""
