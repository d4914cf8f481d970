"""Fleet fuel, idle and cost jobs on Spark."""
