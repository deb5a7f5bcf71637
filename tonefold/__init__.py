"""Instrument-event streams, interval algebra and symbolic melody corpora as Spark jobs."""
