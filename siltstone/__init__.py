"""siltstone: a Spark-native engine for preparing, auditing and analysing text corpora."""
