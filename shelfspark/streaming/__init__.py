"""Jobs that go on where they stopped."""
