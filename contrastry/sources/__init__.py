"""Landing jobs and sinks."""
