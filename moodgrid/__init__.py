"""Geolocated mood analytics as Spark DataFrame jobs."""
