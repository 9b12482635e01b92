"""Models trained by Spark: tasks add up gradients, the driver holds weights only."""
