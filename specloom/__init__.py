"""specloom: analytics over paired 1H/13C peak tables and the molecules they describe, as Spark plans."""
