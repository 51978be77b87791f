"""Operators: each is a fit (distributed aggregate -> small statistics)
followed by an apply (lazy projection or filter)."""
