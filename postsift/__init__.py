"""Mail-corpus preparation, grouping, labelling and classification as Spark DataFrame jobs."""
