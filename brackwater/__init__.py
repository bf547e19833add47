"""brackwater: security-telemetry analytics and corpus preparation on PySpark DataFrames."""
