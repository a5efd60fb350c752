"""Column functions: text, vectors and numbers, all JVM-side."""
