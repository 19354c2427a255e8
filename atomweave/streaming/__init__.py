"""Part of the trajectory engine: streaming."""
