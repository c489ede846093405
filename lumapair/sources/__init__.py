"""Sources and sinks: listings, images, reports."""
