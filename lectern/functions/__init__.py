"""Column builders: titles, metadata rules, text cleanup, vectors."""
