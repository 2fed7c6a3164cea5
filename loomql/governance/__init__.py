"""Operation specs, manifests, migrations, review, the tool server and the CLI."""
