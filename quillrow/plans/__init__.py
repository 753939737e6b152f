"""What to read or write: formats, options, predicates, projections, row schemas and errors."""
