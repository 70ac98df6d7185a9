"""Registered queries, their SQL twins, and the helpers that size joins."""
