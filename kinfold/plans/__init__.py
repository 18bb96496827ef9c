"""Models: compositions of operators."""
