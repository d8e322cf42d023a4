"""Evidence-grounded question answering and its audit, as Spark DataFrame plans."""
