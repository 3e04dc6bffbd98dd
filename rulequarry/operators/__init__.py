"""Rule discovery, joinability, audit, triples and reports over a catalog."""
