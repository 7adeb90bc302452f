"""Column functions: money, text, booleans, dates."""
