"""Analytics over sampled-frame and event-stream tables, as PySpark DataFrame plans."""
