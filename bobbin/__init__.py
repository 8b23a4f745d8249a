"""Spark-native analytics over stitch streams, artwork, thread charts and fonts."""
