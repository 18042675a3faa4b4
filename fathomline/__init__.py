"""A PySpark-native analytics engine for energy-commodity data."""
