"""Citation-network and text analytics written as Spark DataFrame jobs."""
