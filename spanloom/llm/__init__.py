"""Operators for preparing large text collections; nothing else in the library imports this package."""
