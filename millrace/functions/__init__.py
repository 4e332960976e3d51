"""Column expressions: text, grading and reward functions."""
