"""Column functions: boxes, points, vectors and labels."""
