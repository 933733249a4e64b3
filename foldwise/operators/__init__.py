"""Relational operators of the experiment toolkit (DataFrame in, DataFrame out)."""
