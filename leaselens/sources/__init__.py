"""Sources, sinks and model providers."""
