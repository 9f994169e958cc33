"""PySpark-native engine for checking document collections against expectations."""
