"""Distributed primitives shared by several operators."""
