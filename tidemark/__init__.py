"""Spark-native event-study engine over share dealings, with a corpus-preparation subpackage."""
