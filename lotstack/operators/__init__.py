"""Relational, topological, volumetric and point-cloud operators."""
