"""Part of the trajectory engine: functions."""
