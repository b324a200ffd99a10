"""Models, their exact solver and the trackers."""
