"""Column builders. Every function takes and returns a Column and stays inside the JVM unless its docstring says otherwise."""
