"""Column functions: text, identifiers, scores. All of them are compositions of built-in functions."""
