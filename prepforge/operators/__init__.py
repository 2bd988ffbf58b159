"""DataFrame operators: fit is an aggregate, transform is a projection."""
