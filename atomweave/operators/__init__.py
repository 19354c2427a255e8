"""Part of the trajectory engine: operators."""
