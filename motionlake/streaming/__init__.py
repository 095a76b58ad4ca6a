"""Stateful operators, the same for batch and streams."""
