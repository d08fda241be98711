"""Functions of the modelling engine."""
