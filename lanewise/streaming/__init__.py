"""There are no stateful streaming operators: every function of lanewise.functions is a Column
expression without state, and works on a streaming DataFrame as on any other."""
