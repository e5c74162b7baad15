"""Trace and corpus analytics as pure DataFrame -> DataFrame functions on Spark."""
