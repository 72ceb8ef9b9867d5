"""Queries over the test tables and the engine that strings operators together."""
