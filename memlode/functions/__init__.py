"""Column functions: no I/O, no state."""
