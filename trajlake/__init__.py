"""trajlake: analysis of annotated object trajectories on Spark."""
