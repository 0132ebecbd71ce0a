"""Training-data operators: archives, mixing, de-duplication, media, tokens, sharding and filters."""
