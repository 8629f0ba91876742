"""News items in, ranked and audited deals out: DataFrame operators for Apache Spark."""
