"""A PySpark engine that prepares sensor and energy time series for forecasting."""
