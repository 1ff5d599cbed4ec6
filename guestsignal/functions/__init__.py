"""Column-level building blocks; nothing here starts a job."""
