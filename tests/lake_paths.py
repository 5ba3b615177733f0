"""Where the given tables lie (a module, as only one conftest can be imported by name)."""

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
