"""Operators for building training data. Nothing outside this folder imports it."""
