"""Per-file extraction of facts from Python, JavaScript, TypeScript, Go and protobuf sources."""
