"""Training-data operators: each module holds one operator, its query and (where possible) its SQL."""
