"""Sources, sinks and the catalog."""
