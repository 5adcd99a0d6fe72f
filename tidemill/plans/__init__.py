"""The definition plane: identities, canonical JSON, graph documents, the stage catalog and validation."""
