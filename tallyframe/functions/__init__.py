"""Column functions: cleaning, normalisation, classification, similarity."""
