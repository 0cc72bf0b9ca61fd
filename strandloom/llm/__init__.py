"""Training-data operators: decontamination, scoring, fingerprints, scans, packing."""
