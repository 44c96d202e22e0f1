"""tessera: verifiable spatio-temporal trajectory analytics on PySpark."""
