"""quern: a PySpark-native engine for text-to-SQL evaluation data."""
