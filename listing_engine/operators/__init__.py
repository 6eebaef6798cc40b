"""DataFrame -> DataFrame operators; lazy, no actions inside."""
