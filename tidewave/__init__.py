"""tidewave: multi-channel signal analytics expressed as Spark DataFrame plans."""
