"""Operators for text corpora: look-alike text, batch deduplication, name linking, subjects,
tokenizer encoding, evaluation leaks and template residue. Nothing else in newsloom imports this."""
