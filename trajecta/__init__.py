"""Spark-native analytics for trajectories, depth maps, point clouds, grids and frame streams."""
