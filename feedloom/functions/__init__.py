"""Column functions: text rules, guards, scores."""
