"""Timeline, cell-grid and corpus analytics as Spark DataFrame plans."""
