"""Column builders: pure expressions, no joins and no actions."""
