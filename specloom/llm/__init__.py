"""Training-data operators: packing, sharding, line dedup, WARC, extraction, quality, media, joins, search, tokenizers."""
