"""Stateless operators that run unchanged on streams."""
