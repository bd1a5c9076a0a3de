"""Operators for training-data pipelines: de-duplication, fingerprints, token counts, quality, licences, packing, chats."""
