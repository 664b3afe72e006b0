"""evalloom: a PySpark-native engine for building and analysing evaluation benchmarks."""
