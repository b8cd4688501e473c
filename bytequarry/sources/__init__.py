"""Sources and sinks: file scans, foreign containers, the single-file container."""
