"""Vector functions as column expressions."""
