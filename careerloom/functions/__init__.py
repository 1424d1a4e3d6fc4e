"""Column expressions: text rules, numbers, replies, fixed values."""
