"""beaconlake: a PySpark-native analytics engine for search and AI-answer visibility data."""
