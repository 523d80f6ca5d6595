"""Entry points and the catalogue of named queries."""
