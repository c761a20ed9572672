"""Column expressions: colour spaces, parsing, formatting, contrast."""
