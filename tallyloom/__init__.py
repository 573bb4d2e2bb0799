"""Review analytics and corpus operators on Spark."""
