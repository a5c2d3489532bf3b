"""Networks of events that keep coming."""
