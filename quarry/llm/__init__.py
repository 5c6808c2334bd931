"""Operators that prepare collections of code and text for language models; nothing outside imports this package."""
