"""Operators of the modelling engine."""
