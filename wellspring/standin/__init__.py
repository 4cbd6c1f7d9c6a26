"""Stand-in fact tables derived from an order/lineitem star schema, with their SQL."""
