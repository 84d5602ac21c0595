"""Spark jobs over large archives of recorded speech, every table keyed by ``media_id``."""
