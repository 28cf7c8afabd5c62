"""Training-data operators: tokenizing, language id, chat packing, filters,
deduplication, archives, similarity joins and decontamination.

Nothing else in the library imports this subpackage. ``register`` modules
(``queries``) tie each operator to its ``opN_<name>`` query.
"""
