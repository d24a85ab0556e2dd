"""Readers and writers of point, pose and voxel files."""
