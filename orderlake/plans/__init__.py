"""Jobs and reports put together from the operators."""
