"""Plan shapes shared by the operators: blocked scans, binned joins, bounded rounds."""
