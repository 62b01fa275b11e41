"""shelfgap: stock-availability and lost-sales analytics as Spark DataFrame jobs."""
