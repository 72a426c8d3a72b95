"""Training-data operators: near-duplicate removal, extraction, scanning, mixing, packing and search."""
