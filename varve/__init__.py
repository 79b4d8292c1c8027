"""Versioned, content-addressed data on Spark: snapshots, retention, collection, integrity and restore."""
