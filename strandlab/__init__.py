"""strandlab: DNA motif analytics expressed as Spark DataFrame plans."""
