"""quarry: documentation retrieval, evaluation analytics and corpus preparation on Spark."""
