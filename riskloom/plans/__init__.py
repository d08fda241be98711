"""Plans of the modelling engine."""
