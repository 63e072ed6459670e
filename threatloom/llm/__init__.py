"""Training-data operators: token files, archives, decontamination, near-duplicates, language
models, source mixing, licence scans, quality scores, repeated passages and audio columns."""
