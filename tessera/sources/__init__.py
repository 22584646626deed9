"""Files and deliveries as they come in."""
