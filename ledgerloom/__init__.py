"""Invoice-document analytics on Spark: DataFrame operators, no RDDs, no row-at-a-time UDFs."""
