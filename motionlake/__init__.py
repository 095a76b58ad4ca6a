"""PySpark-native analytics for multi-sensor motion recordings."""
