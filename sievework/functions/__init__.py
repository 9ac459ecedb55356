"""Column functions: text, paths, ranks of ordered values, versions."""
