"""Training-data operators: tokenisation, near-duplicates, filtering, privacy,
decontamination, archives, sharding.  Nothing outside this package imports it."""
