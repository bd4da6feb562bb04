"""trapgrid: occupancy tables and threshold studies from camera-trap classifier output, on Spark."""
