"""Column functions: text, vectors, and the two model extension points."""
