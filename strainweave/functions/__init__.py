"""Column expressions: identifiers, labels, dates, weights, sequences."""
