"""Text functions as Column expressions, and the word lists they use."""
