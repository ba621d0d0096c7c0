"""ferrule: a PySpark-native engine for crypto-usage analysis and large-table operators."""
