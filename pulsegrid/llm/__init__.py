"""Training-data operators: quality, privacy, tokens, toxicity, archives, decontamination, language, HTML and near copies.

Nothing else in the library imports this subpackage.
"""
