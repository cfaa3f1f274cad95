"""tidewater: a PySpark-native analytics engine for conversation archives, document corpora, event logs and knowledge graphs."""
