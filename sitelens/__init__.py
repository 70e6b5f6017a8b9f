"""PySpark-native engine for stored web-page snapshots."""
