"""scanloom: Spark DataFrame operators for 3D capture and Gaussian-splat data."""
