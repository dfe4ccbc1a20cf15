"""Part of the rooftide listings-market engine."""
