"""Training-data operators: mixing, filtering, scanning, archives, sharding, language ID, deduplication, media, decontamination."""
