"""Iterative plans: registration, segmentation, optimisation, trajectories."""
