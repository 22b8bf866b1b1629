"""The store on Parquet, its manifest and its log."""
