"""Part of the trajectory engine: plans."""
