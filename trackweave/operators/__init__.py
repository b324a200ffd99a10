"""DataFrame operators on detections, graphs, events and mergers."""
