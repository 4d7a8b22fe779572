"""Part of curvelake."""
