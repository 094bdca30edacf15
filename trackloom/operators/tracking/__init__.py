"""Multi-object tracking over detection logs."""
