"""leadweave: a Spark-native engine for business-lead data and training-corpus preparation."""
