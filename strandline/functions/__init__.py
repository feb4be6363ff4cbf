"""Column functions: text, scores, rules."""
