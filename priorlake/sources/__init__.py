"""Table readers and writers, contest views and data contracts."""
