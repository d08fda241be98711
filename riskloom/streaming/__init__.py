"""Streaming of the modelling engine."""
