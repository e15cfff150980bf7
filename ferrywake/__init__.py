"""PySpark-native analytics over database diagnostics: server logs and metric captures."""
