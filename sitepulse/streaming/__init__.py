from sitepulse.streaming.series import read_series, start_series_stream  # noqa: F401
