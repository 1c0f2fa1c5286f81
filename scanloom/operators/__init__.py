"""DataFrame operators. Every one takes ``by``, the columns that name a capture."""
