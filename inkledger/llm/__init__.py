"""Training-data operators: de-duplication, filtering, labelling, mixing and packing of text corpora."""
