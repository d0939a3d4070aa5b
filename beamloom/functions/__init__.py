"""Column expressions and small scalar rules."""
