"""Column expressions and small dense algebra."""
