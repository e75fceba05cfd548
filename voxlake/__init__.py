"""voxlake: volumes, label arrays and run logs as Spark tables, processed with DataFrame operations."""
