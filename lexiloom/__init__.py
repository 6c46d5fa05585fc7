"""lexiloom: a PySpark-native engine for positional text analytics."""
