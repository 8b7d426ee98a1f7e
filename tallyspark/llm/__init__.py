"""Training-data operators: scoring, packing, labelling, sharding, de-duplication and output of text corpora."""
