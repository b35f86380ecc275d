"""Revenue analytics for booking businesses, written as Spark DataFrame jobs."""
