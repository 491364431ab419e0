"""Training-data operators over whole corpora. Nothing outside this folder imports it."""
