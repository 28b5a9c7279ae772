"""Column functions."""


def register(spark) -> None:
    """Make the signal functions callable from ``spark.sql``."""
    from wavelark.functions.sql import register as add

    add(spark)
