"""Readers that land images, colour lists and catalogues as tables."""
