"""quarrydeck: a code- and text-corpus analytics engine expressed as Spark DataFrame plans."""
