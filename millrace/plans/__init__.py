"""Multi-step plans and the query registry."""
