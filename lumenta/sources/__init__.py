"""Table scans, governed views, crawling and sinks."""
