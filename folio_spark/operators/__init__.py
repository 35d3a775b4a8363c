"""DataFrame operators over pages, runs, corpora and logs."""
