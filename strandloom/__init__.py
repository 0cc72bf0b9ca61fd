"""Strandloom: sequencing analytics and simulation as Spark plans."""
