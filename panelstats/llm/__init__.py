"""Training-data operators: packing, repeats, language, near copies, search, archives, tokens, identity, licences."""
