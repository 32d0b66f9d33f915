"""cloakframe: text privacy and corpus processing as Spark DataFrame operators."""
