"""Page-similarity analytics on Spark: signature joins, compression distance,
prototype selection, page features, classification, batch and streaming."""
