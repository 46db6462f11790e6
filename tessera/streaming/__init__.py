"""Structured Streaming entry points for the stateless operators (cleaning,
encoding, scoring): new files in a folder are processed incrementally with an
exactly-once file sink and a checkpoint in the shared checkpoint folder."""
