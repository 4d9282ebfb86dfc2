"""eraflow: cross-sectional market feature analytics expressed as Spark plans."""
