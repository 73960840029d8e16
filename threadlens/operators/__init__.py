"""DataFrame -> DataFrame operators; lazy, parameterised, free of driver-side loops over data."""
