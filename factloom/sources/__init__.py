"""Where tables come from: the driver's tables, and the store of committed batches."""
