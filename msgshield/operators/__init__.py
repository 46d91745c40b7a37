"""Table operators: table in, table out."""
