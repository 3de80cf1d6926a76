"""A Spark-native analytics engine for line-item budget data and its documents."""
