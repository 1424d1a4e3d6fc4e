"""Composed jobs: the query catalogue, its oracle SQL and the staged build."""
