"""vecspan: a PySpark-native engine for records that carry an embedding vector and scalar metadata."""
