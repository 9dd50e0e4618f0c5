"""The verbs users call, and the queries over the driver's tables."""
