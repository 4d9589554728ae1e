"""quern: an analytics engine expressed as Spark DataFrame plans."""
