"""How rules are compiled, and the plans that evaluate them."""
