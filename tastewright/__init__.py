"""Rating analytics and recommendation as Spark DataFrame jobs."""
