"""Training-data operators: URL rules, language, tokens, near copies, leaks, licences, packing."""
