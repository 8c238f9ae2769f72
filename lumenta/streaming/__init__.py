"""Alert evaluation over an event stream."""
