"""The versioned store on Parquet: catalogue, change log, ingest, transactions."""
