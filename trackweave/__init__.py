"""A PySpark engine for tracking by assignment: detections, candidate graphs, energies, exact labelling, events."""
