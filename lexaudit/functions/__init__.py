"""Column functions: text, hashing, number generation, and the sentence segmenter."""
