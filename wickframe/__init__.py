"""wickframe: candle analytics as DataFrame, Window and SQL expressions on Spark."""
