"""Fingerprint search, media-index analytics and training-data operators as Spark jobs."""
