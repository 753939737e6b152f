"""Column expressions: encoding rows as records, strict conversions, and records as arrays."""
