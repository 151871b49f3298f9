"""Named queries over the driver's tables, each beside its SQL."""
