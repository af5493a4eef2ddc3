"""The smallest test tables; a module of its own, as ``conftest`` names several files."""

SF_SMALL = "/root/testdata/sf0.001"
