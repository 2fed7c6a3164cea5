"""Where tables come from: the engine's catalog, files, JDBC and named drivers."""
