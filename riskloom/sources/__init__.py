"""Sources of the modelling engine."""
