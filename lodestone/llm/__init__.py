"""Training-data operators: deduplication, extraction, classification, mixing and scoring of a text corpus."""
