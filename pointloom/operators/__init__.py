"""Operators on point tables: rows, voxels, neighbours, features."""
