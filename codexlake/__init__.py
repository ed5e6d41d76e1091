"""A document-structure analytics engine made of Spark DataFrame plans."""
