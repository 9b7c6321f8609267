"""Operators for preparing large text corpora; see the README's section on them."""
