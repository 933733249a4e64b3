"""Jobs composed from operators, the fixtures built from the test tables,
and the catalogue of registered queries with their SQL oracles."""
