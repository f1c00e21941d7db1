"""Column functions: text, dates, numbers, rules."""
