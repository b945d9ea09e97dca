"""Column expressions and the few vectorised functions that need linear algebra."""
