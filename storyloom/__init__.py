"""Storyloom: story clustering and feed analytics as PySpark DataFrame programs."""
