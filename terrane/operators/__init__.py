"""Operators: distances, calibration, embedding, density, clusters, merging, quality and covariate maps."""
