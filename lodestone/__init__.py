"""lodestone: a PySpark-native evidence analytics engine."""
