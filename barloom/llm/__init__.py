"""Operators that prepare training text: cleaning, de-duplication, formatting and packing."""
