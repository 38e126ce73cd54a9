"""Sensor-noise analytics on image planes."""
