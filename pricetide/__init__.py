"""Price, offer and crawl analytics as Spark DataFrame jobs."""
