"""Operators over source text and documents. Nothing outside this subpackage imports it."""
