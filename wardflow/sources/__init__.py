"""Where the star comes from and goes to: the driver-table mapping, the
published Parquet star, in-memory frames, the load job and SQL views."""
