"""Transaction anomaly analytics as plain DataFrame -> DataFrame functions."""
