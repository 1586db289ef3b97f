"""Portfolio, price-series and disclosure analytics expressed as Spark plans."""
