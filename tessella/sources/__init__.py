"""Sources, sinks and the experiment registry."""
