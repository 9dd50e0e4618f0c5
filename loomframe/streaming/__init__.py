"""What of the library holds for streams."""
