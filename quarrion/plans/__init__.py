"""Query plans over the supplied tables."""
