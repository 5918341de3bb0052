"""Sources and sinks: file scans, the dataset catalog and the run-history store."""
