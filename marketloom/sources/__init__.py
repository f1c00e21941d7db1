"""Readers: the driver's tables as the domain's views, and files in the formats postings and courses come in."""
