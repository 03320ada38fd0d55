"""Training-data operators: one module per operator, all over the `documents` table shape."""
