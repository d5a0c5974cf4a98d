"""Column expressions: keys, text measures, rules."""
