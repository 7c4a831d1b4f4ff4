"""Column functions: keys, names, labels, frame arithmetic, vectors."""
