"""Column -> Column functions; all JVM-side except the scorers in ``operators.scoring``."""
