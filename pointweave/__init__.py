"""pointweave: annotated 3D point fields as Spark tables."""
