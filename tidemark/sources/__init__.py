"""Sources and sinks of samples: write requests, the block store, and the driver's tables as series."""
