"""Basket-level retail analytics on Spark: ingest, conform, gate, version, enrich, aggregate, audit and model."""
