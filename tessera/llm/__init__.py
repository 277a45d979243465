"""Training-data operators: secrets, near and exact repeats, packing, PII, chat, token files,
quality, media, and benchmark decontamination.  Nothing else in the library imports this package."""
