"""Colour analytics on Spark: DataFrame-to-DataFrame jobs over pixel, colour, pair and palette tables."""
