"""Sources, sinks and the fixture roles built from the driver's tables."""
