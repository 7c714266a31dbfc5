"""DataFrame-to-DataFrame operators over ray clouds. Each is lazy; none collects rows unless its docstring says so."""
