"""Document analytics on Spark: operators over pages, blocks, translations and layout."""
