"""Column-level building blocks: coercion, time arithmetic, metric formulas."""
