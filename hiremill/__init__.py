"""hiremill: analytics over job-posting tables, expressed as Spark DataFrame jobs."""
