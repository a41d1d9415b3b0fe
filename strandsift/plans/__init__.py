"""From options to a plan."""
