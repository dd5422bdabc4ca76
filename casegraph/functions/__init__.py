"""Column functions: text, names, identifiers, dates."""
