"""routelens: API traffic discovery and analytics as Spark DataFrame functions."""
