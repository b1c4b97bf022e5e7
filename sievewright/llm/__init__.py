"""Training-data operators. Nothing outside this package imports it but `util.cut`."""
