"""DataFrame -> DataFrame operators; lazy, free of ``collect`` on the data they transform."""
