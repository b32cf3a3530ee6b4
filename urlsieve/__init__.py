"""urlsieve: URL-risk analytics and corpus preparation as Spark DataFrame operators."""
