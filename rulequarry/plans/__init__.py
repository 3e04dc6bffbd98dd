"""Query plans over a catalog."""
