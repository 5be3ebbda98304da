"""Training-data operators: text extraction, tokenisation, filtering, deduplication, archives."""
