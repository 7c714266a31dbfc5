"""Readers and writers of point-cloud, trajectory, tree and projection files."""
