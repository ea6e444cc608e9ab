"""A PySpark-native engine for people-and-organisation web data."""
