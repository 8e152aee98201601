"""Analytics over fleets of uncertain building models, on Spark."""
