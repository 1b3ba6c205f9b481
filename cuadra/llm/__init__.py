"""Training-data operators: dedup, packing, formatting, classifiers, decontamination, secrets, fingerprints."""
